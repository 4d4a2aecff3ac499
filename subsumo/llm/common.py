"""Helpers shared by the operators: table access, shared scratch folders, word patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import new_path
from ..storage import saved as stored

#: A word: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Rows of whole texts that go to a Python worker at once; the JVM's default is 10,000 of any length.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which hold whole texts on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    small_batches(df.sparkSession)
    return stored(df, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return new_path(spark, name)


#: What this Python worker keeps from batch to batch: of one operator at a time, since workers serve one after the other.
KEPT: dict = {}


def held(key, make: Callable):
    """What `make` gives, kept until the worker turns to another key. Then what was kept goes back to the system before."""
    if key not in KEPT:
        KEPT.clear()
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
        KEPT[key] = make()
    return KEPT[key]


def slices(values: pa.Array | pa.RecordBatch, size: int = 256) -> Iterator[list]:
    """The values as Python lists of bounded length, whatever the size of the batch."""
    for at in range(0, len(values), size):
        yield values.slice(at, size).to_pylist()


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, lengthened until no column of `df` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
