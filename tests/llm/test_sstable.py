import io
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from subsumo.llm import sstable
from subsumo.llm.library import LibraryEncoder
from subsumo.llm.sstable import Shard, ShardWriter, key_of

from .test_bpe import BITS


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = random.Random(2)
    docs = sorted(((None if k < 2 else rng.randrange(-50, 400), np.arange(rng.randrange(40), dtype="<u4") + 7) for k in range(300)), key=lambda d: key_of(d[0]))
    for width in (2, 4):
        file = File()
        writer = ShardWriter(file, width)
        for doc_id, ids in docs:
            writer.add(key_of(doc_id), ids.tobytes())
        writer.close()
        shard = Shard(file)
        assert [(i, x.tolist()) for i, x in shard] == [(i, x.tolist()) for i, x in docs]
        for want in [None, *range(-60, 410)]:
            assert [x.tolist() for x in shard.get(want)] == [x.tolist() for i, x in docs if i == want]
        assert len(shard.index) > 10


def test_library_chunks_equal_whole_texts():
    rng = random.Random(3)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), LibraryEncoder(path)
        texts = ["".join(rng.choices([*BITS, "İ", "́", "Σς", "<|startoftext|>", "　"], k=rng.randint(0, 12))) for _ in range(3000)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_equals_library(spark, tmp_path):
    rows = [(i % 70 - 5, "The words of %d. " % (i % 7) * (i % 11)) for i in range(200)] + [(None, "x y"), (8, None), (9, "")] + [(3, "same")] * 50
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sstable.query(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in {r[1] for r in rows}}
    want = sorted(((i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [key_of(r.doc_id) for r in got] == sorted(key_of(r.doc_id) for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sstable.query(spark, str(tmp_path)).count() == 0


def test_very_long_text(spark, tmp_path):
    text = "".join("words %d go on, and on\n" % (i % 997) for i in range(60_000))
    spark.createDataFrame([(2, text), (1, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
    first, second = sorted(sstable.query(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert (first.doc_id, second.doc_id, second.start, second.n_tokens, second.ids_crc32) == (1, 2, first.n_tokens, len(ids), zlib.crc32(ids.tobytes()))
