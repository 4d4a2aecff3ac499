"""Triples from N-Triples and N-Quads files, prefixes, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import pretty

# A term: an IRI, a literal with language or type, a blank node; kept as written.
TERM = r'(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|_:\S+)'


def checked(paths: str | list[str]) -> list[str]:
    """`*` is allowed in the last segment only."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input path")
    for p in paths:
        if "*" in p.rstrip("/").rpartition("/")[0]:
            raise ValueError(f"a pattern stands before the last segment of {p}")
    return paths


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None, charset: str = "UTF-8") -> DataFrame:
    """(file, line) without comment lines; gzip by extension; a byte-order mark before a line goes; `pattern`: a glob that file names
    must match; `charset`: one that Spark decodes, of 16-bit ones UTF-16LE and UTF-16BE."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    value = F.col("value")
    if charset.upper() != "UTF-8":  # lines come as bytes, cut at this charset's line feed
        reader, value = reader.option("encoding", charset).option("lineSep", "\n"), F.regexp_replace(F.decode(value.cast("binary"), charset), "\r$", "")
    lines = reader.text(checked(paths)).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(value, "^\\uFEFF", "").alias("line"))
    return lines.where(~F.col("line").startswith("#"))


def parse_triples(lines: DataFrame, tabs: bool = False, quads: bool = False) -> DataFrame:
    """(s, p, o) of the column `line`; a line that is no statement is an error, blank lines are not lines."""
    gap = r"\t" if tabs else r"\s+"
    graph = rf"(?:{gap}(?:<[^>]*>|_:\S+))?" if quads else ""
    statement = rf"^\s*{TERM}{gap}{TERM}{gap}{TERM}{graph}\s*\.\s*$"
    line = F.col("line")
    parts = [F.regexp_extract(line, statement, k) for k in (1, 2, 3)]
    bad = F.raise_error(F.concat(F.lit("not a statement: "), line))
    kept = lines.where(F.length(F.trim(line)) > 0)
    return kept.select(*[F.when(line.rlike(statement), part).otherwise(bad).alias(n) for part, n in zip(parts, "spo", strict=True)])


def read_triples(spark: SparkSession, paths: str | list[str], tabs: bool = False, pattern: str | None = None, charset: str = "UTF-8") -> DataFrame:
    """N-Quads if the first path ends in nq, else N-Triples."""
    return parse_triples(read_lines(spark, paths, pattern, charset), tabs, checked(paths)[0].endswith("nq"))


def parse_prefixes(lines: DataFrame) -> DataFrame:
    """(prefix, url) of lines `@prefix x: <url> .` or `@prefix <url> .`; any other line is an error."""
    line = F.col("line")
    named, base = r"^@prefix\s+(\S+): <(\S+)>\s*\.$", r"^@prefix\s+<(\S+)>\s*\.$"
    bad = F.raise_error(F.concat(F.lit("not a prefix: "), line))
    return lines.select(
        F.when(line.rlike(named), F.regexp_extract(line, named, 1)).when(line.rlike(base), F.lit("")).otherwise(bad).alias("prefix"),
        F.when(line.rlike(named), F.regexp_extract(line, named, 2)).otherwise(F.regexp_extract(line, base, 1)).alias("url"),
    )


def read_prefixes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_prefixes(read_lines(spark, paths))


def cind_text() -> Column:
    dep, ref = (pretty(F.col(f"{x}c"), F.col(f"{x}1"), F.col(f"{x}2")) for x in "dr")
    return F.concat(dep, F.lit(" < "), ref, F.lit(" (support="), F.col("support").cast("string"), F.lit(")"))


def rule_text() -> Column:
    ante, cons = (pretty(F.col(f"{x}_type"), F.col(x), F.lit("")) for x in ("ante", "cons"))
    return F.format_string("%s -> %s (support=%d,confidence=%3.2f%%)", ante, cons, F.col("support"), F.col("confidence") * 100)


def write_text(lines: DataFrame, path: str) -> None:
    """One text column; a single file on a local path."""
    (lines.coalesce(1) if path.startswith("file:") else lines).write.mode("overwrite").text(path)
