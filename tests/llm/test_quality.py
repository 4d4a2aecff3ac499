import numpy as np
import pytest

from subsumo.llm import quality
from subsumo.llm.quality import Forest, fit
from subsumo.llm.textstats import FEATURES


def walked(forest: Forest, row):
    """One row down every tree, node by node."""
    total, inner = forest.prior, forest.feature.shape[1]
    for feature, limit, value in zip(forest.feature, forest.limit, forest.value):
        node = 0
        while node < inner:
            node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
        total += value[node - inner]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = fit(x, y)
    seen = rng.normal(size=(300, 5))
    assert np.allclose(forest.score(seen), [walked(forest, r) for r in seen])
    assert ((forest.score(seen) > 0.5) == ((seen[:, 0] > 0.2) ^ (seen[:, 3] > 0))).mean() > 0.95


def test_first_split_has_the_most_gain():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = (x[:, 1] > 6).astype(float)
    forest = fit(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(k, cut):
        low = x[:, k] <= cut
        return g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)

    best = max(((gain(k, c), k, c) for k in range(3) for c in range(11)), key=lambda t: t[0])
    assert forest.feature[0, 0] == best[1] and best[2] <= forest.limit[0, 0] < best[2] + 1


def test_without_rows_the_score_is_the_prior():
    forest = fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert forest.score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]


def test_held_out_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    auc = ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2
    assert len(bad) > 50 and auc >= 0.99


@pytest.mark.parametrize("empty", [False, True])
def test_hard_rows(spark, tmp_path, empty):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text, 1, "x", False) for r in real]
    rows += [rows[0], (None, real[1].text, 2, None, True), (9000, None, 3, "y", None), (9001, "", 3, "y", None), (9002, "word " * 300_000, 3, "y", None)]
    schema = "doc_id long, text string, quality int, score string, held_out boolean"
    spark.createDataFrame([] if empty else rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    extra = spark.createDataFrame([(9001, None), (None, 1), (3, 7)], "doc_id long, quality int").selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in labels.dtypes])
    labels.unionByName(labels).unionByName(extra).write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.query(spark, str(tmp_path)).collect()
    assert len(got) == (0 if empty else len(rows))
    scores = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert scores.setdefault(r.doc_id, r.score) == r.score
    if not empty:
        assert scores[9000] == scores[9001] and next(r for r in got if r.doc_id is None).held_out is False
