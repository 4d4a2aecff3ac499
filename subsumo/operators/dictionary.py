"""Compression of values by a hash dictionary: `#hash` where a hash stands for one value, `~value` where several share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import digest
from ..storage import saved


def distinct_values(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "p", "o")).alias("value")).distinct()


def hash_groups(values: DataFrame, algorithm: str = "MD5", length: int | None = None) -> DataFrame:
    """(hash, value, n): the least value of every hash and how many values share it; `length` cuts hashes."""
    hashed = digest(F.col("value"), algorithm)
    return values.select("value", (F.substring(hashed, 1, length) if length else hashed).alias("hash")).groupBy("hash").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))


def dictionary(groups: DataFrame) -> DataFrame:
    """(hash, value), escaped, of the hashes without collision."""
    return groups.where("n = 1").select(F.concat(F.lit("#"), F.col("hash")).alias("hash"), "value")


def compress(rows: DataFrame, columns: list[str], groups: DataFrame, algorithm: str = "MD5", length: int | None = None) -> DataFrame:
    """Non-empty values of `columns` by their code; values that share a hash are escaped instead."""
    colliding = saved(groups.where("n > 1").select(F.col("hash").alias("bad")), "colliding")  # few or none: the planner sees its size
    for c in columns:
        hashed = digest(F.col(c), algorithm)
        rows = rows.withColumn("h", F.substring(hashed, 1, length) if length else hashed).join(colliding, F.col("h") == F.col("bad"), "left")
        code = F.when(F.col("bad").isNull(), F.concat(F.lit("#"), F.col("h"))).otherwise(F.concat(F.lit("~"), F.col(c)))
        rows = rows.withColumn(c, F.when(F.col(c) == "", F.col(c)).otherwise(code)).drop("h", "bad")
    return rows


def decompressed(value: Column, entry: Column) -> Column:
    missing = F.raise_error(F.concat(F.lit("no dictionary entry for "), value))
    return F.coalesce(entry, F.when(value.startswith("~"), F.substring(value, F.lit(2), F.length(value))).when(value.startswith("#"), missing).otherwise(""))


def decompress(rows: DataFrame, columns: list[str], entries: DataFrame) -> DataFrame:
    """The inverse of `compress`; a hash without an entry is an error."""
    for c in columns:
        # Only hashes look for an entry: the many empty and escaped values do not meet in one partition.
        hashed = rows.where(F.col(c).startswith("#")).join(entries.select(F.col("hash").alias(c), F.col("value").alias("entry")), c, "left")
        plain = rows.where(~F.col(c).startswith("#")).withColumn("entry", F.lit(None).cast("string"))
        both = hashed.select(plain.columns).unionByName(plain)
        rows = both.withColumn(c, decompressed(F.col(c), F.col("entry"))).drop("entry")
    return rows
