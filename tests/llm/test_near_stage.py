"""The near-duplicate stage of the pipeline: five words, 0.8."""

import random

import numpy as np
import pytest

import corpus_pipeline
from subsumo.llm import jaccard

from .test_jaccard import documents, variants


def fives(text):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept(rows):
    """Ids of the documents that stay, by comparing all pairs."""
    sets = [fives(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(least.values())


@pytest.mark.parametrize("small", [jaccard.SMALL, 6])
def test_stage_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(4)
    texts = [t for _, t in documents(2)] + [t for length, count, edits in ((200, 25, 7), (90, 25, 3)) for t in variants(rng, length, count, edits)]
    words = ["p%d" % i for i in range(200)]
    texts += [" ".join(words), " ".join(words[:165])]  # a passage cut: 0.82 at five words, 0.82 at three
    shared = " ".join("s%d" % i for i in range(12))
    texts += [shared + " " + " ".join("u%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(80)]  # a common passage, no copies
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.ngram_join(spark, docs, "").collect())
    assert got == kept(rows)


def test_prefixes_and_sketches_miss_no_link():
    rng, rule, seen = random.Random(5), jaccard.Rule(5, 80), 0
    for _ in range(2000):
        a = {rng.getrandbits(63) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 200, 900]))}
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, len(a) // 4)))) | {rng.getrandbits(63) for _ in range(rng.randint(0, len(a) // 8))}
        if jaccard.linked(a, b, rule):
            seen += 1
            common = np.array(sorted(rng.sample(sorted(a | b), len(a) // 3)), np.uint64)
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert set(jaccard.prefix(x, rule, common).tolist()) & set(jaccard.prefix(y, rule, common).tolist())
            bits = [np.frombuffer(jaccard.sketch(s), np.uint8) for s in (x, y)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(a ^ b)
    assert seen > 500


def test_common_passage_stays_out_of_prefixes(spark):
    """A passage of a third of each document is common as a whole, wherever its hashes fall; the most frequent come last."""
    rng, rule = random.Random(6), jaccard.Rule(5, 80)
    passage = " ".join("s%d" % i for i in range(44))
    texts = [passage + " " + " ".join("u%d" % rng.randrange(10**9) for _ in range(100)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common, rank = jaccard.common_shingles(docs, rule)
    shared = set(jaccard.hashed_set(jaccard.words_of(passage), rule).tolist())
    assert shared <= set(common.tolist()) and sorted(rank.tolist()) == list(range(1, len(common) + 1))
    for text in texts:
        assert not shared & set(jaccard.prefix(jaccard.hashed_set(jaccard.words_of(text), rule), rule, common, rank).tolist())
    s = np.arange(10, dtype=np.uint64)
    assert jaccard.prefix(s, jaccard.Rule(5, 10), s[4:7], np.array([2, 3, 1])).tolist() == [0, 1, 2, 3, 7, 8, 9, 6, 4, 5]


def test_linked_sets_share_a_key_below_ninety():
    """Segments of the universe, whatever shingles are common: the keys of the pipeline's rule too."""
    rng, rule, seen = random.Random(7), jaccard.Rule(5, 80), 0
    for _ in range(1500):
        n = max(1, rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 16, 31, 62, 64, 124, 250, 475]) + rng.randint(-1, 1))
        a, gone = {rng.getrandbits(64) for _ in range(n)}, rng.randint(0, n // 4)
        b = set(rng.sample(sorted(a), max(1, n - gone))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 4 - gone))}
        if jaccard.linked(a, b, rule):
            seen += 1
            common = np.array(sorted(rng.sample(sorted(a | b), rng.choice([0, n // 3, n * 9 // 10, len(a | b)]))), np.uint64)
            often = common, np.array(rng.sample(range(1, len(common) + 1), len(common)), np.int64)
            (ea, da), (eb, db) = ([set(x.tolist()) for x in jaccard.all_keys(np.array(sorted(s), np.uint64), rule, often)] for s in (a, b))
            assert ea & eb or ea & db or da & eb
    assert seen > 900


def test_deletions_are_weighed():
    """Bands below ninety have one-deletion neighbourhoods where those are the cheapest."""
    rule = jaccard.Rule(5, 80)
    for k in range(12):
        m, deletions = jaccard.allocation(k, rule)
        assert m + deletions >= jaccard.most_errors(k, rule.least) + 1
    assert jaccard.allocation(2, rule) == (1, 1)  # sets of four to seven


def test_documents_with_a_common_part_hardly_meet(spark, monkeypatch):
    """Groups that share a quarter of their words, too small to be seen as common: they were compared with each other, pair by pair."""
    rng, seen, stored = random.Random(8), {}, jaccard.saved

    def counted(df, name):
        out = stored(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    monkeypatch.setattr(jaccard, "SMALL", 6)
    texts = []
    for g in range(20):
        part = " ".join("s%d_%d" % (g, i) for i in range(30))
        texts += [part + " " + " ".join("u%d" % rng.randrange(10**9) for _ in range(90)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard.one_of_each(docs, corpus_pipeline.NEAR).count() == len(texts)
    assert seen.get("met", 0) + seen.get("pairs", 0) < len(texts)
