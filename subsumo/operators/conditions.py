"""Frequent conditions and perfect association rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def structs(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])


def unary_conditions(triples: DataFrame, support: int) -> DataFrame:
    """(type, value, count) of the values of each attribute in at least `support` triples."""
    rows = structs([(1, F.col("s")), (2, F.col("p")), (4, F.col("o"))], ("type", "value"))
    return triples.select(F.inline(rows)).groupBy("type", "value").count().where(F.col("count") >= support)


def binary_conditions(triples: DataFrame, support: int, unary: DataFrame | None = None) -> DataFrame:
    """(type, v1, v2, count); with `unary`, pairs of an infrequent value are dropped before they are counted."""
    rows = structs([(3, F.col("s"), F.col("p")), (5, F.col("s"), F.col("o")), (6, F.col("p"), F.col("o"))], ("type", "v1", "v2"))
    if unary is not None:
        for attribute, bit in (("s", 1), ("p", 2), ("o", 4)):
            good = unary.where(F.col("type") == bit).select(F.col("value").alias(attribute), F.lit(True).alias(f"good_{attribute}"))
            triples = triples.join(good, attribute, "left")
        pairs = [(3, "s", "p"), (5, "s", "o"), (6, "p", "o")]
        rows = F.filter(F.array(*[F.when(F.col(f"good_{a}") & F.col(f"good_{b}"), F.struct(F.lit(t).alias("type"), F.col(a).alias("v1"), F.col(b).alias("v2"))) for t, a, b in pairs]), lambda x: x.isNotNull())
    return triples.select(F.inline(rows)).groupBy("type", "v1", "v2").count().where(F.col("count") >= support)


def association_rules(unary: DataFrame, binary: DataFrame) -> DataFrame:
    """(ante_type, cons_type, ante, cons, support, confidence) of the rules of confidence 1 between frequent conditions."""
    low = F.col("type").bitwiseAND(-F.col("type"))
    high = F.col("type").bitwiseAND(F.col("type") - 1)
    sides = F.array(
        F.struct(low.alias("ante_type"), high.alias("cons_type"), F.col("v1").alias("ante"), F.col("v2").alias("cons")),
        F.struct(high.alias("ante_type"), low.alias("cons_type"), F.col("v2").alias("ante"), F.col("v1").alias("cons")),
    )
    both = binary.select(F.inline(sides), F.col("count").alias("support"))
    alone = unary.select(F.col("type").alias("ante_type"), F.col("value").alias("ante"), F.col("count").alias("alone"))
    rules = both.join(alone, ["ante_type", "ante"]).where("support = alone")
    return rules.select("ante_type", "cons_type", "ante", "cons", "support", F.lit(1.0).alias("confidence"))
