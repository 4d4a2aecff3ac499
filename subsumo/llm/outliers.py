"""Operator 2: quality rules by robust multivariate outliers.

Base rules reject texts of under 50 words or of mostly repeated 3-word windows. Of what they pass, every language and source
gets a minimum-covariance-determinant estimate of location and scatter of transformed statistics (VECTOR), and a
document whose squared Mahalanobis distance exceeds a chi-squared quantile is rejected.

The estimate takes concentration steps over all documents from three starts (medians with two diagonal scatters, plain
moments): each step keeps the share `SHARE` of a group nearest to the last estimate and takes their mean and covariance, and
of the three results that of the least determinant counts. Which those are is read off a
histogram of distances whose bins carry counts, sums and sums of products, so that a step is one aggregation with map-side
combination, however large a group is; the kept share is rounded up to a whole bin. Statistics are fixed-point
integers, hence the sums are exact and independent of the order of rows. Groups of under `LEAST` documents use their
language's estimate, languages of under `LEAST` that of all; under `LEAST` in all, nothing is rejected. Variances have
floors in every direction, since a statistic that is constant in most documents would make any other value an outlier.
A distance equal to the limit is kept; texts of any length are read whole, one by one.

Null texts are empty: they have no words and fail the base rules. Null languages or sources are groups of their own.
Repeated rows count as often as they occur and get the same verdict; extra columns pass through; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .textstats import FEATURES, measured as table_of, ratios

VECTOR = ("word_length", "symbols", "repeats", "upper", "bangs", "variety")
P = len(VECTOR)
#: Fixed-point units of a statistic, and the bound of its absolute value in them.
UNIT, BOUND = 1000, 20_000
#: Least standard deviations.
FLOOR = np.array([0.35, 0.25, 0.08, 0.03, 0.25, 0.03])
SHARE, STEPS, LEAST = 0.6, 6, 50
#: A document of a clean group is rejected with this probability, were its statistics normal.
TAIL = 1e-6
#: Bins of the logarithm of a squared distance.
BINS, BINS_PER_E = 256, 16
#: Up to so many groups their estimates are broadcast (about 300 bytes each).
BROADCAST_GROUPS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = "struct<" + ",".join(f"{b}:long" for b in BASE) + "," + ",".join(f"{v}:int" for v in VECTOR) + ">"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_cdf(x: float, freedom: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi2_quantile(q: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, freedom) < q else (low, mid)
    return high


LIMIT = chi2_quantile(1 - TAIL, P)
#: What makes the covariance of the nearest share of a normal sample consistent.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


def vectors(c: np.ndarray) -> np.ndarray:
    """The VECTOR, in units, of rows of counts."""
    f = dict(zip(FEATURES, ratios(c).T, strict=True))
    variety = np.log1p(c[:, 6]) / np.maximum(np.log1p(c[:, 0]), 1)
    columns = (f["word length"], np.log1p(10 * f["symbols"]), f["repeated words"], f["upper"], np.log1p(10 * f["bangs"]), variety)
    return np.clip(np.rint(np.column_stack(columns) * UNIT), -BOUND, BOUND).astype(np.int32)


def text_statistics(text: Column) -> Column:
    """A struct of the BASE counts and the VECTOR."""

    @F.arrow_udf(STATISTICS)
    def measure(texts: pa.Array) -> pa.Array:
        c = table_of(texts)
        v = vectors(c)
        arrays = [pa.array(np.ascontiguousarray(c[:, k])) for k in range(len(BASE))] + [pa.array(np.ascontiguousarray(v[:, k])) for k in range(P)]
        return pa.StructArray.from_arrays(arrays, [*BASE, *VECTOR])

    return measure(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def distance(center: Column, inverse: Column, x: list[Column]) -> Column:
    """Squared Mahalanobis distance; `inverse`: the upper triangle, off-diagonal entries doubled."""
    d = [x[i] - center[i] for i in range(P)]
    return reduce(lambda a, b: a + b, [inverse[k] * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)])


def triangle(inverse: np.ndarray) -> list[float]:
    return [float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS]


def floored(cov: np.ndarray) -> np.ndarray:
    """`cov` with no direction's variance below that of the floors: eigenvalues in units of the floors are at least one."""
    unit = FLOOR * UNIT
    values, directions = np.linalg.eigh(cov / np.outer(unit, unit))
    return (directions * np.maximum(values, 1.0)) @ directions.T * np.outer(unit, unit)


def scatter_of(n: float, sums, products, consistency: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, the latter with its floors."""
    mean = np.array([float(x) for x in sums]) / n
    cov = np.zeros((P, P))
    for (i, j), s in zip(PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = float(s) / n - mean[i] * mean[j]
    return mean, floored(cov * consistency)


def estimates_of(pdf: pd.DataFrame, start: list[int], rows: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    keys = pdf[["level", "g_lang", "g_source"]].iloc[rows].reset_index(drop=True)
    return keys.assign(start=start, center=[c.tolist() for c, _ in found], inverse=[triangle(np.linalg.inv(v)) for _, v in found], spread=[float(np.linalg.slogdet(v)[1]) for _, v in found])


def starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Three starts of each group: the medians with the floors as scatter, the medians with scatter by quartiles, and the plain moments."""
    number, rows, found = [], [], []
    for k, row in enumerate(pdf.itertuples(index=False)):
        q = np.array([list(x) for x in row.quartiles], float)
        wide = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR * UNIT)
        of_group = [(q[:, 1], np.diag((FLOOR * UNIT) ** 2)), (q[:, 1], np.diag(wide**2)), scatter_of(float(row.n), row.sums, row.products, 1.0)]
        number, rows, found = number + list(range(len(of_group))), rows + [k] * len(of_group), found + of_group
    return estimates_of(pdf, number, rows, found)


def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Center, inverse scatter and its log determinant of each row of sums."""
    found = [scatter_of(float(row.n), row.sums, row.products, CONSISTENCY) for row in pdf.itertuples(index=False)]
    return estimates_of(pdf, list(pdf["start"]), list(range(len(pdf))), found)


ESTIMATES = "level int, g_lang string, g_source string, start int, center array<double>, inverse array<double>, spread double"
KEYS = ["level", "g_lang", "g_source"]


def with_estimates(rows: DataFrame, estimates: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """Joined by KEYS; beyond BROADCAST_GROUPS by a shuffle, whose large partitions adaptive execution splits."""
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, KEYS, how)


def group_key(column: Column) -> Column:
    """Nulls as a key of their own."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def at_levels(rows: DataFrame) -> DataFrame:
    """Each row once for every level, with the keys of that level."""
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.withColumn("g_lang", F.when(F.col("level") > 0, F.col("g_lang")).otherwise("")).withColumn("g_source", F.when(F.col("level") > 1, F.col("g_source")).otherwise(""))


def fit(narrow: DataFrame) -> tuple[DataFrame, int]:
    """Estimates by KEYS, and their number, from `narrow` (lang, source, s): level 2 is for a language and source, 1 for a language, 0 for all."""
    x = [F.col(f"s.{v}") for v in VECTOR]
    passed = narrow.where(~base_failed(F.col("s"))).select(group_key(F.col("lang")).alias("g_lang"), group_key(F.col("source")).alias("g_source"), *[a.cast("long").alias(v) for a, v in zip(x, VECTOR, strict=True)])
    # Equal vectors of a group are one row with a weight: copies, however many, cost one.
    weighted = passed.groupBy("g_lang", "g_source", *VECTOR).agg(F.count(F.lit(1)).alias("w"))
    counted = at_levels(passed.groupBy("g_lang", "g_source").count()).groupBy(*KEYS).agg(F.sum("count").alias("size"))
    sizes = saved(counted.where(F.col("size") >= LEAST), "sizes")
    groups = sizes.count()
    points = saved(with_estimates(at_levels(weighted), sizes, groups), "points")
    w, values = F.col("w"), [F.col(v) for v in VECTOR]
    moments = [
        F.sum("w").alias("n"),
        F.array(*[F.sum(w * a) for a in values]).alias("sums"),
        F.array(*[F.sum(w * values[i] * values[j]) for i, j in PAIRS]).alias("products"),
    ]
    quartiles = F.array(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000).cast("array<double>") for v in VECTOR]).alias("quartiles")
    # A vector counts once in the quartiles: they only begin the search.
    first = points.groupBy(*KEYS).agg(quartiles, *moments)
    estimates = saved(first.mapInPandas(lambda parts: map(starts, parts), ESTIMATES), "start")
    runs = [*KEYS, "start"]
    for _ in range(STEPS):
        near = with_estimates(points, estimates, groups)
        square = distance(F.col("center"), F.col("inverse"), values)
        binned = near.withColumn("bin", F.least(F.greatest(F.floor(F.log(square + 1e-3) * BINS_PER_E) + 112, F.lit(0)), F.lit(BINS - 1)).cast("int"))
        sums = binned.groupBy(*runs, "bin").agg(F.first("size").alias("size"), *moments)
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*runs).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = sums.withColumn("before", before).where(F.col("before") < F.ceil(F.col("size") * SHARE))
        whole = kept.groupBy(*runs).agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("sums")[i]) for i in range(P)]).alias("sums"),
            F.array(*[F.sum(F.col("products")[k]) for k in range(len(PAIRS))]).alias("products"),
        )
        estimates = saved(whole.mapInPandas(lambda parts: map(estimate, parts), ESTIMATES), "estimates")
    least = F.min(F.struct("spread", "start", "center", "inverse"))
    return saved(estimates.groupBy(*KEYS).agg(least.alias("e")).select(*KEYS, "e.center", "e.inverse", "e.spread"), "least"), groups


def judged(docs: DataFrame, estimates: DataFrame, groups: int, statistics: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """`docs` with `kept`: not failed by the base rules, nor rejected by the estimate of its group, else language, else all."""
    s, out = F.col(statistics), docs
    picked = []
    for k in (2, 1, 0):
        e = estimates.where(F.col("level") == k).select(F.col("g_lang").alias(f"_l{k}"), F.col("g_source").alias(f"_s{k}"), F.struct("center", "inverse").alias(f"_e{k}"))
        e = F.broadcast(e) if groups <= BROADCAST_GROUPS or k == 0 else e
        on = (F.lit(True) if k == 0 else group_key(F.col(lang)) == F.col(f"_l{k}")) & (group_key(F.col(source)) == F.col(f"_s{k}") if k == 2 else F.lit(True))
        out = out.join(e, on, "left")
        picked.append(F.col(f"_e{k}"))
    best = F.coalesce(*picked)
    square = distance(best["center"], best["inverse"], [s[v] for v in VECTOR])
    return out.withColumn("kept", ~base_failed(s) & F.coalesce(square <= LIMIT, F.lit(True)))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", text_statistics(F.col("text")).alias("s"))


def sound_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with its columns."""
    estimates, groups = fit(saved(measured(docs), "statistics"))
    row, s = "row", "s"
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), text_statistics(F.col("text")).alias(s), F.col("lang").alias("of_lang"), F.col("source").alias("of_source"))
    kept = judged(wrapped, estimates, groups, s, "of_lang", "of_source").where("kept")
    return kept.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = saved(measured(table(spark, sf_dir, "documents")), "statistics")
    estimates, groups = fit(docs)
    return judged(docs, estimates, groups, "s").select("doc_id", *[F.col(f"s.{b}").alias(b) for b in BASE], base_failed(F.col("s")).alias("base_failed"), "kept")
