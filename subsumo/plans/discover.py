"""Discovery of conditional inclusion dependencies as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import asciify, shorten
from ..operators import pairs
from ..operators.captures import Groups
from ..operators.conditions import association_rules, binary_conditions, unary_conditions
from ..storage import saved


@dataclass(frozen=True)
class Config:
    """`mode`: "broad" for every dependency, "minimal" for those that none implies directly; "levelwise" finds the minimal
    ones from unary pairs upwards. `use_rules`: leave out what perfect association rules imply.
    `direct`: count pairs in groups (True) or seek references in smallest groups (False); by the size of the groups if None.
    """

    support: int = 10
    projection: str = "spo"
    mode: str = "broad"
    use_rules: bool = False
    distinct: bool = False
    ascii: bool = False
    direct: bool | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("broad", "minimal", "levelwise") or not self.projection or set(self.projection) - set("spo") or self.support < 1:
            raise ValueError(f"not a valid configuration: {self}")


def prepared(triples: DataFrame, config: Config, prefixes: DataFrame | None = None) -> DataFrame:
    if config.ascii:
        triples = triples.withColumns({c: asciify(F.col(c)) for c in "spo"})
    if prefixes is not None:
        triples = shorten(triples, prefixes)
    return triples.distinct() if config.distinct else triples


def frequent(triples: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Unary and binary conditions; infrequent values are pruned before pairs are counted."""
    unary = saved(unary_conditions(triples, support), "unary")
    return unary, binary_conditions(triples, support, unary)


def rules(triples: DataFrame, support: int) -> DataFrame:
    return association_rules(*frequent(triples, support))


def discover(triples: DataFrame, config: Config = Config(), prefixes: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(dc, d1, d2, rc, r1, r2, support) of the dependencies in `triples` (s, p, o); with `entries` (hash, value), which
    `dictionary.compress` used, values stand for their hashes."""
    triples = saved(prepared(triples, config, prefixes).select(*"spo").distinct(), "triples")
    groups = Groups(triples, config.support, config.projection, config.use_rules, entries)
    if config.mode == "levelwise":
        cinds = pairs.Levels(groups).minimal()
    else:
        cinds = pairs.dependencies(groups, config.direct)
        if config.mode == "minimal":
            cinds = pairs.minimal(saved(cinds.select("a", "b", "support"), "cinds"), groups)
    if config.use_rules:
        cinds = pairs.without_rule_implied(cinds, groups)
    if "dc" not in cinds.columns:
        cinds = groups.named(cinds)
    return cinds.select(*pairs.DEP, *pairs.REF, "support")
