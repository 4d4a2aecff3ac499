"""The catalogue of queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import asciify, shorten
from .operators import conditions, dictionary, pairs, profile
from .operators.captures import Groups, captures
from .plans.discover import Config, discover, frequent, rules
from .sources import rdf, tables
from .storage import saved

SUPPORT = 10
PREFIXES = [("dbpr", "http://items.example/id/"), ("dbpc", "http://items.example/id/Kind:"), ("u", "urn:example:unused")]


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.triples(spark, sf).distinct()


def groups_of(spark: SparkSession, sf: str, projection: str = "spo") -> Groups:
    return Groups(saved(facts(spark, sf), "triples"), SUPPORT, projection)


def cinds(**options):
    return lambda spark, sf: discover(tables.triples(spark, sf), Config(support=SUPPORT, **options))


def of_shape(dep: int, ref: int):
    return lambda spark, sf: pairs.shape(cinds()(spark, sf), dep, ref)


def overlaps_11(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.unary_overlaps(groups_of(spark, sf))


def proper_overlaps_11(spark: SparkSession, sf: str) -> DataFrame:
    groups = groups_of(spark, sf)
    ways = pairs.both_ways(pairs.unary_overlaps_by_id(groups, pairs.class_overlaps(groups)))
    return groups.named(ways.where("overlap < support")).select("dc", "d1", "rc", "r1", "support", "overlap")


def candidates(generate):
    """Candidates as captures; `generate`: from the levels."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        levels = pairs.Levels(groups_of(spark, sf))
        return levels.groups.named(generate(levels)).select(*pairs.DEP, *pairs.REF)

    return run


def frequent_captures(spark: SparkSession, sf: str) -> DataFrame:
    return Groups(saved(facts(spark, sf), "triples"), SUPPORT).frequent.select("code", "v1", "v2", "support")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The triples as N-Triples lines, literals for the objects of `segment`, and a comment line."""
    o = F.when(F.col("p") == "segment", F.concat(F.lit('"'), F.col("o"), F.lit('"@en'))).otherwise(F.concat(F.lit("<http://x/"), F.col("o"), F.lit(">")))
    made = facts(spark, sf).select(F.concat(F.lit("<http://x/"), F.col("s"), F.lit("> <http://x/"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("line"))
    return made.unionByName(spark.createDataFrame([("# a comment",)], "line string"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return rdf.parse_triples(lines(spark, sf).where(~F.col("line").startswith("#")))


def shortened(spark: SparkSession, sf: str) -> DataFrame:
    longer = facts(spark, sf).select(*[F.concat(F.lit("<http://items.example/id/"), F.when(F.col(c).startswith("n"), "Kind:").otherwise(""), F.col(c), F.lit(">")).alias(c) for c in ("s", "o")], "p")
    return shorten(longer, spark.createDataFrame(PREFIXES, "prefix string, url string"))


def asciified(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select(asciify(F.concat(F.lit("é"), F.col("s"))).alias("s"), "p", asciify(F.col("o")).alias("o"))


def hash_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dictionary(dictionary.hash_groups(dictionary.distinct_values(facts(spark, sf)), length=4))


def decompressed_cinds(spark: SparkSession, sf: str) -> DataFrame:
    triples = facts(spark, sf)
    values = saved(dictionary.hash_groups(dictionary.distinct_values(triples)), "hashes")
    short = dictionary.compress(triples, ["s", "p", "o"], values)
    return discover(short, Config(support=SUPPORT), entries=dictionary.dictionary(values))


def queries() -> dict:
    return {
        "triples": lambda s, d: tables.triples(s, d),
        "distinct_triples": facts,
        "unary_conditions": lambda s, d: conditions.unary_conditions(facts(s, d), SUPPORT),
        "binary_conditions": lambda s, d: frequent(facts(s, d), SUPPORT)[1],
        "association_rules": lambda s, d: rules(facts(s, d), SUPPORT),
        "captures": lambda s, d: captures(facts(s, d)),
        "capture_support": frequent_captures,
        "capture_groups_hist": lambda s, d: profile.group_histogram(captures(facts(s, d))),
        "group_load": lambda s, d: profile.group_load(captures(facts(s, d))),
        "overlaps_11": overlaps_11,
        "proper_overlaps_11": proper_overlaps_11,
        "cinds_11": of_shape(1, 1),
        "cinds_12": of_shape(1, 2),
        "cinds_21": of_shape(2, 1),
        "cinds_22": of_shape(2, 2),
        "cinds_all": cinds(),
        "cinds_seeded": cinds(direct=False),
        "cinds_minimal": cinds(mode="minimal"),
        "cinds_levelwise": cinds(mode="levelwise"),
        "cinds_ar_pruned": cinds(use_rules=True),
        "cinds_proj_s": cinds(projection="s"),
        "cinds_proj_so": cinds(projection="so"),
        "candidates_12": candidates(lambda x: pairs.candidates_12(x.c11, x.groups)),
        "candidates_21": candidates(lambda x: pairs.candidates_21(x.proper, x.groups)),
        "candidates_22": candidates(lambda x: x.upper()[2]),
        "cind_shapes": lambda s, d: profile.shape_counts(cinds()(s, d)),
        "cinds_pretty": lambda s, d: cinds()(s, d).select(rdf.cind_text().alias("line")),
        "ar_pretty": lambda s, d: rules(facts(s, d), SUPPORT).select(rdf.rule_text().alias("line")),
        "condition_histogram": lambda s, d: profile.condition_histogram(facts(s, d)),
        "distinct_value_kinds": lambda s, d: profile.distinct_value_kinds(parsed(s, d)),
        "count_lines": lambda s, d: profile.count_lines(lines(s, d)),
        "hash_collisions": lambda s, d: profile.hash_collisions(dictionary.distinct_values(facts(s, d)), length=4),
        "hash_dictionary": hash_dictionary,
        "decompressed_cinds": decompressed_cinds,
        "shorten_iris": shortened,
        "asciify": asciified,
        "parse_ntriples": parsed,
    }
