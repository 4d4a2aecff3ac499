"""Command line: python -m subsumo PROGRAM FILE... [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionary, profile
from .operators.captures import captures
from .plans.discover import Config, discover, frequent, prepared, rules
from .sources import rdf
from .storage import saved

PROGRAMS = ("find", "count-conditions", "count-values", "count-triples", "check-hashes")

# Physical options that other programs of this kind know. They change no result, and this engine chooses by itself.
PHYSICAL_SWITCHES = ("--use-fis", "--no-combinable-join", "--no-bulk-merge", "--rebalance-join", "--any-binary-captures", "--find-frequent-captures", "--balanced-overlap-candidates")
PHYSICAL_NUMBERS = (
    "--frequent-condition-strategy", "--rebalance-strategy", "--rebalance-split", "--rebalance-threshold", "--rebalance-max-load",
    "--merge-window-size", "--debug-level", "--explicit-threshold", "--hash-bytes", "--sbf-bytes",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="subsumo", description=__doc__)
    p.add_argument("program", choices=PROGRAMS)
    p.add_argument("inputs", nargs="+", help="N-Triples or N-Quads files, plain or gzip; * in the last segment")
    p.add_argument("--tabs", action="store_true", help="fields are separated by tabs")
    p.add_argument("--pattern", help="a glob that the names of the input files must match")
    p.add_argument("--charset", default="UTF-8", help="of the input files")
    p.add_argument("--prefixes", nargs="*", default=[], help="prefix files to shorten IRIs with")
    p.add_argument("--distinct-triples", action="store_true")
    p.add_argument("--asciify-triples", action="store_true")
    p.add_argument("--support", type=int, default=10)
    p.add_argument("--projection", default="spo")
    p.add_argument("--traversal-strategy", type=int, default=1, choices=range(4), help="0, 2, 3: all at once; 1: levelwise (minimal results)")
    p.add_argument("--clean-implied", action="store_true", help="only dependencies that no other implies")
    p.add_argument("--use-ars", action="store_true", help="leave out what association rules imply")
    p.add_argument("--hash-dictionary", action="store_true", help="discover on hashes of the values")
    p.add_argument("--hash-function", default="MD5", choices=["MD5", "SHA-1", "SHA-256"])
    p.add_argument("--output", help="text output of the dependencies")
    p.add_argument("--ar-output", help="text output of the association rules")
    p.add_argument("--collect-result", action="store_true", help="print the dependencies")
    p.add_argument("--only-read", action="store_true")
    p.add_argument("--find-only-fcs", action="store_true")
    p.add_argument("--do-only-join", action="store_true")
    p.add_argument("--create-join-histogram", action="store_true")
    p.add_argument("--counters", action="store_true", help="print the number of dependencies of each shape")
    p.add_argument("--print-plan", action="store_true")
    ignored = p.add_argument_group("physical options, accepted without effect")
    for name in PHYSICAL_SWITCHES:
        ignored.add_argument(name, action="store_true")
    for name in PHYSICAL_NUMBERS:
        ignored.add_argument(name, type=float)
    return p


def sink(df: DataFrame) -> None:
    """Computes and drops the rows."""
    df.write.format("noop").mode("overwrite").save()


def show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(*row, sep=";")


def find(spark: SparkSession, args: argparse.Namespace) -> None:
    triples = rdf.read_triples(spark, args.inputs, args.tabs, args.pattern, args.charset)
    prefixes = rdf.read_prefixes(spark, args.prefixes) if args.prefixes else None
    mode = "levelwise" if args.traversal_strategy == 1 else "minimal" if args.clean_implied else "broad"
    config = Config(args.support, args.projection, mode, args.use_ars, args.distinct_triples, args.asciify_triples)
    triples = prepared(triples, config, prefixes)
    if args.only_read:
        return sink(triples)
    if args.find_only_fcs:
        for conditions in frequent(triples, args.support):
            sink(conditions)
        return None
    if args.ar_output:
        rdf.write_text(rules(triples, args.support).select(rdf.rule_text().alias("line")), args.ar_output)
    if args.create_join_histogram:
        show(profile.group_histogram(captures(triples, args.projection)).orderBy("size"))
    if args.do_only_join:
        return sink(captures(triples, args.projection))
    config = Config(args.support, args.projection, mode, args.use_ars)
    if args.hash_dictionary:
        values = saved(dictionary.hash_groups(dictionary.distinct_values(triples), args.hash_function), "hashes")
        short = dictionary.compress(triples, ["s", "p", "o"], values, args.hash_function)
        cinds = discover(short, config, entries=dictionary.dictionary(values))
    else:
        cinds = discover(triples, config)
    if args.print_plan:
        cinds.explain("formatted")
    cinds = saved(cinds, "cinds")
    if args.output:
        rdf.write_text(cinds.select(rdf.cind_text().alias("line")), args.output)
    if args.collect_result:
        show(cinds.select(rdf.cind_text()))
    if args.counters:
        show(profile.shape_counts(cinds))
    print(f"{cinds.count()} dependencies")
    return None


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("subsumo").getOrCreate()
    if args.program == "find":
        return find(spark, args)
    if args.program == "count-triples":
        return show(profile.count_lines(rdf.read_lines(spark, args.inputs, args.pattern, args.charset)))
    triples = rdf.read_triples(spark, args.inputs, args.tabs, args.pattern, args.charset)
    prefixes = rdf.read_prefixes(spark, args.prefixes) if args.prefixes else None
    triples = prepared(triples, Config(distinct=args.distinct_triples), prefixes)
    if args.program == "count-conditions":
        return show(profile.condition_histogram(triples).orderBy("type", "count"))
    if args.program == "count-values":
        return show(profile.distinct_value_kinds(triples))
    return show(profile.hash_collisions(triples.select(F.explode(F.array("s", "p", "o")).alias("value")).distinct(), args.hash_function))


if __name__ == "__main__":
    main()
