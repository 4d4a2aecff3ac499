"""Operator 4: BPE encoding and decoding.

Encoding merges the symbols of a piece with a priority queue of merge ranks over a doubly linked symbol list: every
adjacent pair with a rank waits in the queue by rank, then place; an entry whose symbols have changed meanwhile is
stale and skipped. Decoding concatenates the byte strings of the vocabulary.

Null texts count as empty and give no ids; ids outside the vocabulary are an error. Rows are independent: repeated
rows, ties and extra columns pass through, an empty table gives an empty table.
"""

from __future__ import annotations

import json
import sys
from array import array
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import held, slices, table

#: The split pattern of the byte-level vocabularies (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class MergeQueueBPE:
    """A byte-level BPE read from a tokenizers file."""

    def __init__(self, path: str, limit: int = 160 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        #: For each left id the rank by right id.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (left, right) in enumerate(pairs):
            self.ranks[vocab[left]][vocab[right]] = rank
        self.made = [vocab[left + right] for left, right in pairs]
        symbols = byte_symbols()
        self.start = [vocab[s] for s in symbols]
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        words |= {i: t.encode() for t, i in self.special.items()}
        self.words = [words[i] for i in range(max(words) + 1)]
        self.pieces = regex.compile(SPLIT).findall
        self.special_parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.cache = ChunkCache(lambda chunks: map(self.packed, chunks), tuple(self.special), limit)

    def merged(self, piece: bytes) -> list[int]:
        start, ranks, made = self.start, self.ranks, self.made
        ids = [start[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        # The rank of each symbol with its right neighbour, or none: an entry that differs from it is stale.
        rank = [ranks[a].get(b, -1) for a, b in pairwise(ids)]
        rank.append(-1)
        queue = [r * n + i for i, r in enumerate(rank) if r >= 0]  # by rank, then place
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            r, i = divmod(heappop(queue), n)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i] = new = made[r]
            ids[j] = rank[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = ranks[new].get(ids[k], -1)
                if r >= 0:
                    heappush(queue, r * n + i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = ranks[ids[h]].get(new, -1)
                if r >= 0:
                    heappush(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def packed(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit integers; its pieces are looked up like chunks."""
        if chunk[1:].isalpha() and chunk[0] in " abcdefghijklmnopqrstuvwxyz" and max(chunk) < "\u0250":
            return pack(self.merged(chunk.encode()))  # letters only: one piece
        out, kept = [], self.cache.kept
        for part in self.special_parts(chunk):
            if part in self.special:
                out.append(pack([self.special[part]]))
                continue
            for piece in self.pieces(part):
                if (ids := kept.get(piece)) is None:
                    ids = pack(self.merged(piece.encode()))
                    self.cache.keep(piece, ids)
                out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def text(self, ids: list[int]) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode("utf-8", "replace")


def bpe(path: str) -> MergeQueueBPE:
    """The one of this Python worker."""
    return held(("merge queue", path), lambda: MergeQueueBPE(path))


def bpe_encode(text: Column, path: str) -> Column:
    """array<int> of the ids of `text`; `path`: a tokenizers file that every executor can open."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        cache = bpe(path).cache
        found = [ids for part in slices(texts) for ids in cache.encode(part)]
        ends = np.cumsum([0, *(len(b) // 4 for b in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        flat, ends, gone, text = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_null().to_pylist(), bpe(path).text
        return pa.array([None if gone[k] else text(flat[ends[k] : ends[k + 1]].tolist()) for k in range(len(lists))], pa.string())

    return decode(ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe_encode(F.coalesce("text", F.lit("")), path).alias("ids"))
    both = docs.withColumn("decoded", bpe_decode(F.col("ids"), path))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
