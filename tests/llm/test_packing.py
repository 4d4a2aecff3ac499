import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from subsumo.llm import packing
from subsumo.llm.packing import nnls, patterns, plan


def first_fit(counts, capacity):
    left, bins = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True), []
    for n in left:
        for b in bins:
            if b[0] >= n:
                b[0] -= n
                break
        else:
            bins.append([capacity - n])
    return len(bins)


def test_nnls_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.random((6, 4)), rng.normal(size=6)
        best = min(np.linalg.norm(a @ x - b) for s in product([0, 1], repeat=4) for x in [np.zeros(4)] if (x.__setitem__(np.flatnonzero(s), np.linalg.lstsq(a[:, np.flatnonzero(s)], b, rcond=None)[0]) or True) and (x >= -1e-12).all())
        assert abs(np.linalg.norm(a @ nnls(a, b) - b) - best) < 1e-8


def test_patterns_fill_the_grid():
    found = patterns(12, 3)
    assert len(found) == len(set(found)) and all(sum(p) == 12 for p in found)
    assert {(12,), (6, 6), (5, 4, 3), (2,) * 6, (5, 5, 2)} <= set(found)


def test_plans_are_whole_and_tight():
    rng = random.Random(7)
    for capacity, spread in ((64, 2), (512, 4), (4096, 6), (4096, 1.2), (7, 2)):
        for size in (0, 1, 5, 300, 3000):
            counts = defaultdict(int)
            for _ in range(size):
                counts[max(1, min(capacity, int(capacity * rng.random() ** spread)))] += rng.choice([1, 1, 3])
            made = plan(dict(counts), capacity)
            rows = made.placed()
            cells = defaultdict(list)
            for k, (n, first, sequence, offset) in enumerate(rows):
                until = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == n else counts[n]
                for r in range(first, until):
                    cells[sequence + r - first].append((offset, n))
            assert sum(map(len, cells.values())) == sum(counts.values()) and len(cells) == made.sequences
            for placed in cells.values():
                at = 0
                for offset, n in sorted(placed):
                    assert offset == at
                    at += n
                assert at <= capacity
            total = sum(n * c for n, c in counts.items())
            assert made.sequences <= max(-(-total // capacity) * 1.02 + 2, first_fit(counts, capacity) + 1)


def test_query_equals_library(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 150, "Some words of it, %d! " % i * rng.choice([1, 3, 40, 900])) for i in range(200)] + [(None, "a\x1cb"), (7, None), (9, "")] + [(3, "Same. ")] * 60
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    cells = defaultdict(list)
    for r in got:
        cells[r.sequence_id].append((r.offset, r.length))
    for placed in cells.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 4096
    counts = defaultdict(int)
    for r in got:
        counts[r.length] += 1
    assert len(cells) <= first_fit(counts, 4096)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.query(spark, str(tmp_path)).count() == 0


def test_very_long_text(spark, tmp_path):
    text = "".join("words %d go on, and on\n" % (i % 997) for i in range(60_000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array([*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 1], "<u4")
    got = sorted(packing.query(spark, str(tmp_path)).collect(), key=lambda r: r.piece)
    assert [(r.start, r.length, r.ids_crc32) for r in got] == [(s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
