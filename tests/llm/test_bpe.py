import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from subsumo.llm import bpe
from subsumo.llm.bpe import MergeQueueBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "a", "the", "Thou", "'s", "'LL", "<|endoftext|>", "é", "ß", "é", "日本", "🎉", "123", "½", "_", "...", "\x00"]


def test_ids_and_text_equal_the_library():
    library, own, rng = Tokenizer.from_file(PATH), MergeQueueBPE(PATH), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices(BITS, k=rng.randint(0, 12)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert own.ids(s) == ids
        assert own.cache.encode([s])[0] == b"".join(i.to_bytes(4, "little") for i in ids)
        assert own.text(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_do_not_change_ids():
    own, small = MergeQueueBPE(PATH), MergeQueueBPE(PATH, limit=400)
    texts = ["some words and some more words", "words again, and again", "x" * 5000, "", None]
    assert own.cache.encode(texts) == small.cache.encode(texts)


def test_query_with_nulls_and_extra_columns(spark, tmp_path):
    rows = [(1, "The words. The words."), (1, "The words. The words."), (2, None), (3, ""), (None, "é"), (5, "ab " * 3000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bpe.query(spark, str(tmp_path)).collect()), key=str)
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.query(spark, str(tmp_path)).count() == 0
