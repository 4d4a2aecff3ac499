import random

import numpy as np
import pytest

from subsumo.llm import jaccard
from subsumo.llm.components import components
from subsumo.llm.jaccard import all_keys, linked, shingles


def brute(rows, rule=jaccard.OWN):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, rule) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], rule):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def sets_near(rng):
    n = max(1, rng.choice([1, 3, 9, 10, 12, 17, 18, 20, 30, 60, 100, 250, 700]) + rng.randint(-2, 2))
    a = {rng.getrandbits(63) for _ in range(n)}
    b = set(a)
    for _ in range(rng.randint(0, max(1, n // 6))):
        if rng.random() < 0.6 and len(b) > 1:
            b.remove(rng.choice(sorted(b)))
        if rng.random() < 0.6:
            b.add(rng.getrandbits(63))
    return a, b


def test_linked_sets_share_a_key():
    rng, seen = random.Random(1), 0
    for _ in range(3000):
        a, b = sets_near(rng)
        if linked(a, b):
            seen += 1
            (ea, da), (eb, db) = ([set(x.tolist()) for x in all_keys(np.array(sorted(s), np.uint64))] for s in (a, b))
            assert ea & eb or ea & db or da & eb
    assert seen > 1000


def variants(rng, length, count, edits):
    words = ["w%d" % rng.randrange(5000) for _ in range(length)]
    out = []
    for _ in range(count):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(5000)
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out


def documents(seed):
    rng = random.Random(seed)
    texts = [t for length, count, edits in ((200, 60, 6), (60, 40, 3), (35, 30, 3), (12, 20, 1), (400, 25, 16), (25, 40, 2)) for t in variants(rng, length, count, edits)]
    texts += ["w1 w2", "W1\tw2", "w1 w2 w3", "w1", "", " \n", None, None, "é É", "É É", "a b a b a b a b", "a b a b"]
    chain = ["c%d" % i for i in range(300)]
    texts += [" ".join(chain[i : i + 240]) for i in range(0, 60, 2)]  # neighbours link, ends do not
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "quite alone here now")]
    return rows


@pytest.mark.parametrize("small", [jaccard.SMALL, 6])
def test_equals_brute_force(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "ROWS", 8)
    rows = documents(1)
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, uid int, label string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, jaccard.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert jaccard.query(spark, str(tmp_path)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 150)]
    edges = spark.createDataFrame([*path, *star, (200, 200), (7, 3)], "u long, v long")
    got = {r.u: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_one_of_each_keeps_columns(spark):
    words = " ".join("w%d" % i for i in range(100))
    near = words.replace("w50", "x")
    rows = [(5, words, "a"), (2, near, "b"), (2, near, "b"), (9, "other words of it", "c"), (9, "other  words of it", "d"), (None, words, "e"), (None, "lonely text here", "f"), (11, None, "g"), (12, "", "h"), (13, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    assert got == sorted([2, 9, None, 11, 12, 13], key=str)


def test_very_long_texts(spark, tmp_path):
    words = ["w%d" % (i * 7919 % 50_021) for i in range(200_000)]
    near, far = list(words), list(words)
    for i in range(0, 200_000, 150):
        near[i] = "x"
    for i in range(0, 200_000, 20):
        far[i] = "x%d" % i
    texts = {1: words, 2: near, 3: far, 4: words[:50]}
    sets = {k: shingles(" ".join(w)) for k, w in texts.items()}
    assert linked(sets[1], sets[2]) and not linked(sets[1], sets[3])
    spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, jaccard.query(spark, str(tmp_path)).collect()))
    assert got == [(k, len(sets[k]), 1 if k == 2 else k) for k in texts]
