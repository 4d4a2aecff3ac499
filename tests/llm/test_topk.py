import duckdb
import numpy as np
import pytest

from subsumo.llm import topk


def brute(rows):
    """By the contract: every usable row is a candidate of every other one, whatever their ids."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for k, (q, v) in enumerate(kept):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(kept) if j != k)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:10])]
    return sorted(out)


def test_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [3.0, 0.0]), (6, [3_000_000.0, 0.0]), (0, [1.0, 0.0]), (100, [-1.0, 1e6]), (7, [4.0e6, 4.0e6]), (8, [float("inf"), 0.0]), (200, [2e6, 1.0]), (9, [1e5, 7.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    huge = spark.createDataFrame([(0, [1e200]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(huge).collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


@pytest.mark.parametrize("shape", ["even", "long tail", "copies", "few"])
def test_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "SLICE", 32)
    rng = np.random.default_rng(3)
    n = 6 if shape == "few" else 900
    x = rng.normal(size=(n, 24)).astype(np.float32)
    if shape == "long tail":
        x *= (rng.pareto(1.5, n)[:, None] + 0.1).astype(np.float32)
    if shape == "copies":
        x[100:500] = x[100]
    rows = [(i, x[i].tolist()) for i in range(n)]
    if shape == "even":
        rows += [(None, rows[0][1]), (2000, None), (2100, [float("nan")] * 24), (2200, [None] * 24), (7, rows[7][1]), (2300, rows[5][1][:10]), (2400, [0.0] * 24)]
    got = topk.top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.query(spark, sf).collect())) == sorted(db.sql(topk.SQL).fetchall())
