"""Functions on the values of triples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(text: str) -> str:
    """From the first non-ASCII character on, every UTF-16 unit as 7-bit characters, lowest bits first; lossy."""
    if text.isascii():
        return text
    first = next(i for i, c in enumerate(text) if ord(c) > 127)
    out, units = [text[:first]], text[first:].encode("utf-16-le", "surrogatepass")
    for unit in memoryview(units).cast("H"):
        while True:
            out.append(chr(unit & 127))
            unit >>= 7
            if not unit:
                break
    return "".join(out)


def asciify(value: Column) -> Column:
    """ASCII values pass through in the JVM; only the others visit Python."""

    @F.arrow_udf("string")
    def convert(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else chunks(v) for v in values.to_pylist()], pa.string())

    return F.when(value.rlike("^[\\x00-\\x7F]*$"), value).otherwise(convert(value))


def shorten(triples: DataFrame, prefixes: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Values <url...> with their longest prefix from `prefixes` (prefix, url) as prefix:rest; a url that occurs twice is an error.

    Values meet the urls that begin as they do, up to the length of the shortest url, in a join; Spark broadcasts the
    prefixes if they are small enough.
    """
    known = prefixes.select("prefix", "url")
    n, distinct, least = known.agg(F.count(F.lit(1)), F.count_distinct("url"), F.min(F.length("url"))).first()
    if distinct < n:
        raise ValueError("a prefix url occurs twice")
    if not n:
        return triples
    options = F.sort_array(F.collect_list(F.struct(F.length("url").alias("n"), "url", "prefix")), asc=False)
    stems = known.groupBy(F.substring("url", 1, least).alias("stem")).agg(options.alias("options"))  # the longest come first
    out = triples
    for c in columns:
        value, stem, choice = F.col(c), f"{c} stem", f"{c} options"
        begins = F.when(value.startswith("<") & value.endswith(">"), F.substring(value, 2, least))
        out = out.join(stems.select(F.col("stem").alias(stem), F.col("options").alias(choice)), begins == F.col(stem), "left")
        best = F.get(F.filter(choice, lambda x: F.startswith(value, F.concat(F.lit("<"), x["url"]))), F.lit(0))  # noqa: B023
        rest = F.substring(value, best["n"] + 2, F.length(value) - best["n"] - 2)
        out = out.withColumn(c, F.coalesce(F.concat(best["prefix"], F.lit(":"), rest), value))
    return out.select(triples.columns)


def digest(value: Column, algorithm: str = "MD5") -> Column:
    """Hexadecimal hash of a value."""
    return {"MD5": F.md5, "SHA-1": F.sha1, "SHA-256": lambda v: F.sha2(v, 256)}[algorithm](value)
