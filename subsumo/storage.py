"""Intermediate results that several later steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def own_folder() -> str:
    """A folder of this process, for local sessions; it goes with the process."""
    path = tempfile.mkdtemp(prefix="subsumo-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; an own one only in a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = own_folder()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what lies there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_parts(df: DataFrame, name: str, by: str) -> dict[object, DataFrame]:
    """`df` by the few values of the column `by`, which goes: each part is a table of its own, whose size the planner sees."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    rest = df.drop(by).schema
    reader = df.sparkSession.read
    values = [r[0] for r in reader.schema(df.schema).parquet(path).select(by).distinct().collect()]
    return {v: reader.schema(rest).parquet(f"{path}/{by}={v}") for v in values}
