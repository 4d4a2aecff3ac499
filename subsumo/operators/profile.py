"""Small analyses of triples and of capture groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import implied, size
from .conditions import structs
from .dictionary import hash_groups


def condition_histogram(triples: DataFrame) -> DataFrame:
    """(type, count, conditions): how many conditions of each type hold for `count` triples; type 0: of all types."""
    s, p, o = (F.col(c) for c in "spo")
    rows = structs([(1, s, ""), (2, p, ""), (4, o, ""), (3, s, p), (5, s, o), (6, p, o)], ("type", "v1", "v2"))
    counts = triples.select(F.inline(rows)).groupBy("type", "v1", "v2").count()
    by_type = counts.groupBy("type", "count").agg(F.count(F.lit(1)).alias("conditions"))
    return by_type.unionByName(by_type.groupBy("count").agg(F.sum("conditions").alias("conditions")).select(F.lit(0).alias("type"), "count", "conditions"))


def distinct_value_kinds(triples: DataFrame) -> DataFrame:
    """(urls, literals): distinct values that do not, and that do, begin with a quotation mark."""
    values = triples.select(F.explode(F.array("s", "p", "o")).alias("value")).distinct()
    literal = F.coalesce(F.col("value").startswith('"'), F.lit(False))
    return values.agg(F.count_if(~literal).alias("urls"), F.count_if(literal).alias("literals"))


def count_lines(lines: DataFrame) -> DataFrame:
    """(lines): those that are no comments."""
    return lines.where(~F.col("line").startswith("#")).agg(F.count(F.lit(1)).alias("lines"))


def hash_collisions(values: DataFrame, algorithm: str = "MD5", length: int | None = None) -> DataFrame:
    """(free, colliding): hashes of one value, and values whose hash others share."""
    groups = hash_groups(values, algorithm, length)
    return groups.agg(F.count_if(F.col("n") == 1).alias("free"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))


def group_histogram(captures: DataFrame) -> DataFrame:
    """(size, groups): how many values have `size` captures."""
    return captures.groupBy("value").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def group_load(captures: DataFrame) -> DataFrame:
    """(groups, pairs, average_pairs, block): the work of comparing all captures within groups, and the group size of average work."""
    sizes = captures.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    square = F.col("size") * F.col("size")
    sums = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(square), F.lit(0)).alias("pairs"))
    average = F.col("pairs") / F.col("groups")
    return sums.select("groups", "pairs", average.alias("average_pairs"), F.round(F.sqrt(average)).cast("long").alias("block"))


def shape_counts(cinds: DataFrame) -> DataFrame:
    """(dep, ref, cinds, support, trivial): dependencies and their support by the sizes of their conditions; no trivial one should be there."""
    dep, ref = (tuple(F.col(f"{x}{k}") for k in "c12") for x in "dr")
    shape = cinds.groupBy(size(F.col("dc")).alias("dep"), size(F.col("rc")).alias("ref"))
    return shape.agg(F.count(F.lit(1)).alias("cinds"), F.sum("support").alias("support"), F.count_if(implied(dep, ref)).alias("trivial"))
