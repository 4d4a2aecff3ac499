"""Operator 1: a quality classifier of histogram gradient-boosted trees over document statistics.

Features are binned by their quantiles; each tree of fixed depth is grown level by level from histograms of gradients and
hessians of the logistic loss. The trees are flattened into arrays of a complete binary tree each, which numpy
walks for a whole batch at once. Training rows are a bounded sample (`bound`, by hash of doc_id) of labelled
documents whose crc32(doc_id) mod 4 is not 2; the other labelled ones are held out.

Labels other than 0 and 1 and null ids are left out of training; of several labels of an id the largest counts, of
several texts the smallest statistics. Null and empty texts get the score of all-zero statistics. A null doc_id is not
held out. Without training rows every score is the prior, one half. Repeated rows and extra columns do no harm; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table
from .textstats import FEATURES, measured, ratios

#: At most so many labelled documents are learnt from.
TRAINING_ROWS = 20_000
#: A document is predicted good from this score on.
GOOD = 0.7


@dataclass
class Forest:
    """`feature`, `limit`: trees x inner nodes; `value`: trees x leaves. A row goes right where it exceeds the limit."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 4.0) -> Forest:
    """Boosted trees for labels 0 and 1."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    n, p = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(p)]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])  # bin b: edges[b-1] < x <= edges[b]
    share = (y.sum() + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    total = np.full(n, prior)
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), prior)
    for t in range(trees):
        good = 1 / (1 + np.exp(-total))
        gradient, hessian = good - y, good * (1 - good)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best, best_gain = [(0, bins)] * width, np.full(width, 1e-6)
            for k in range(p):
                place = (node - first) * bins + binned[:, k]
                g = np.bincount(place, gradient, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(place, hessian, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gs, hs = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least / 4) | (hs - hl < least / 4)] = 0
                cut = gain.argmax(1)
                for w in np.flatnonzero(gain[np.arange(width), cut] > best_gain):
                    best_gain[w], best[w] = gain[w, cut[w]], (k, int(cut[w]))
            chosen, cuts = np.array([b[0] for b in best]), np.array([b[1] for b in best])
            at = node - first
            node = 2 * node + 1 + (binned[np.arange(n), chosen[at]] > cuts[at])
            for w, (k, cut) in enumerate(best):
                forest.feature[t, first + w] = k
                forest.limit[t, first + w] = edges[k][cut] if cut < len(edges[k]) else np.inf
        leaf = node - inner
        forest.value[t] = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + ridge)
        total += forest.value[t][leaf]
    return forest


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array(list(ratios(measured(texts))), pa.list_(pa.float64()))

    return measure(text)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Forest:
    """A forest from `docs` (doc_id, text) and `labels` (doc_id, quality); the driver gets `bound` rows of statistics at most."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # no more than `bound` rows are broadcast
    rows = rows.select("doc_id", "quality", statistics(F.col("text")).alias("x")).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r"))
    found = sorted(rows.collect(), key=lambda r: r.doc_id)
    x = np.array([r.r.x for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r.r.quality for r in found], float))


def quality_score(text: Column, forest: Forest) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(ratios(measured(texts))), pa.float64())

    return score(text)


def good_documents(docs: DataFrame, forest: Forest, least: float = GOOD) -> DataFrame:
    """The rows of `docs` that score `least` or more, with its columns."""
    score = free_name(docs, "score")
    scored = docs.withColumn(score, quality_score(F.col("text"), forest))
    return scored.where(F.col(score) >= least).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
