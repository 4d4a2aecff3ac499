import random
import re
from collections import Counter

import numpy as np

from subsumo.llm import outliers
from subsumo.llm.textstats import FIELDS, counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "é", "a b a", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "#", "|x", "日本", "\x0b"]) for _ in range(rng.randrange(30)))
        assert counts(text)[:5] == brute(text), repr(text)
    assert counts(None) == [0] * len(FIELDS)


def sentences(rng, n=80):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def documents():
    rng = random.Random(5)
    rows = [(i, sentences(rng), rng.choice(["en", "de", None]), "hot" if i % 3 else None, "x") for i in range(400)]
    rows += [(1000 + i, sentences(rng).replace(" ", "### "), "en", "hot", None) for i in range(20)]
    rows += [(2000 + i, sentences(rng).upper() + "!", "de", "rare", None) for i in range(3)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "hot", None), (None, "a b " * 60, "en", "hot", None), (7, rows[7][1], *rows[7][2:])]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def test_planted_outliers(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = outliers.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        r, b = by_id[doc_id], brute(text)
        assert list(r[1:6]) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert r.kept == (doc_id is not None and doc_id < 1000), doc_id


def test_stage_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    out = outliers.sound_documents(docs)
    assert out.columns == docs.columns and out.count() == 401
    assert outliers.sound_documents(docs.limit(0)).count() == 0


def test_estimate_resists_contamination(spark):
    """Equal to plain moments of the clean part, roughly, with a third of the rows far away."""
    rng = np.random.default_rng(6)
    clean, far = rng.normal(5000, 400, (3000, outliers.P)), rng.normal(12000, 300, (1400, outliers.P))
    rows = [(100, 0, 0, 0, 0, *map(int, v)) for v in np.vstack([clean, far])]
    names = [*outliers.BASE, *outliers.VECTOR]
    frame = spark.createDataFrame(rows, names).selectExpr("'en' as lang", "'s' as source", f"struct({','.join(names)}) as s")
    estimates, groups = outliers.fit(frame)
    assert groups == 3
    for r in estimates.collect():
        assert np.abs(np.array(r.center) - 5000).max() < 60
        spread = np.sqrt(np.diag(np.linalg.inv([[r.inverse[outliers.PAIRS.index((min(i, j), max(i, j)))] / (1 if i == j else 2) for j in range(outliers.P)] for i in range(outliers.P)])))
        want = np.maximum(400, outliers.FLOOR * outliers.UNIT)
        assert (np.abs(spread / want - 1) < 0.25).all()  # a kept share above the clean one widens it


def test_floors_are_least_variances_of_every_direction():
    unit = outliers.FLOOR * outliers.UNIT
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(outliers.P, outliers.P)))[0]
    cov = (turn * [0, 0.25, 0.99, 1.5, 4, 100]) @ turn.T * np.outer(unit, unit)
    got = np.linalg.eigvalsh(outliers.floored(cov) / np.outer(unit, unit))
    assert np.allclose(got, [1, 1, 1, 1.5, 4, 100])


def test_the_least_determinant_counts(spark):
    """Rows on a tight line and a wide cloud nearer to the medians: the start that ends on the line wins."""
    rng = np.random.default_rng(7)
    tight, wide = rng.normal(3000, 30, (1300, outliers.P)), rng.normal(9000, 900, (700, outliers.P))
    rows = [(100, 0, 0, 0, 0, *map(int, v)) for v in np.vstack([tight, wide])]
    names = [*outliers.BASE, *outliers.VECTOR]
    frame = spark.createDataFrame(rows, names).selectExpr("'en' as lang", "'s' as source", f"struct({','.join(names)}) as s")
    for r in outliers.fit(frame)[0].collect():
        assert np.abs(np.array(r.center) - 3000).max() < 30


def test_long_text_and_empty_table(spark, tmp_path):
    long = sentences(random.Random(1), 200_000)
    spark.createDataFrame([(1, long, "en", "hot", "x")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    row = outliers.query(spark, str(tmp_path)).first()
    assert row.n_words == 200_000 and list(row[1:6]) == brute(long) and row.kept
