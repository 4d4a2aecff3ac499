"""Operator 6: token ids as sorted-string-table shards.

A shard holds documents in ascending key order (null first, then doc_id). Its layout, integers little-endian:

    block*   zstd of entries: varint length of the prefix shared with the key before, varint length of the rest, varint
             length of the value, rest of the key, value; the first key of a block is whole
    index    zstd of one entry per block: 9 bytes first key, u64 offset, u32 stored length, u32 crc32 of the stored bytes
    Bloom    a bit set of ten bits a key, asked at seven places
    footer   magic, u32 bytes of an id, u64 documents, u64 ids, then offset and length of index and Bloom, u32 crc32

The value of a document is its ids, two bytes each where the vocabulary allows. A lookup asks the Bloom filter, finds the
block by binary search in the index and scans it. Shards are range partitions of the ids (ties spread by a
hash of the text, equal rows by a number, so that an id that many rows share spans shards), each written under a
temporary name in the shared folder and renamed: a task that runs again writes the same file.

Null texts count as empty; a null doc_id sorts first; rows that repeat a doc_id all stay, in any order; extra columns
are ignored; an empty table gives no shard. The folder must be reachable by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch, table
from .library import encoder

MAGIC = b"SUBSST01"
FOOTER = struct.Struct("<8sIQQQQQQI")
INDEX_ENTRY = struct.Struct("<9sQII")
#: A block is closed at this size.
BLOCK_BYTES = 1 << 18
BITS, PROBES = 10, 7
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def doc_id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Takes (key, ids as 32-bit integers) in ascending key order and writes to a binary file."""

    def __init__(self, file, id_bytes: int):
        self.file, self.id_bytes, self.at, self.docs, self.tokens = file, id_bytes, 0, 0, 0
        self.block, self.first, self.last, self.index, self.keys = bytearray(), b"", b"", [], []
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(9) if key[i] != self.last[i]), 9)
        value = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.id_bytes == 2 else ids
        self.block += varint(shared) + varint(9 - shared) + varint(len(value)) + key[shared:] + value
        if key != self.last or not self.docs:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.index.append(INDEX_ENTRY.pack(self.first, *self.put(data), zlib.crc32(data)))
            self.block = bytearray()

    def close(self) -> None:
        self.end_block()
        index = self.put(self.pack(b"".join(self.index)))
        size = max(64, BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(size, bool)
        bloom[[p for key in self.keys for p in places(key, size)]] = True
        where = self.put(np.packbits(bloom, bitorder="little").tobytes())
        footer = FOOTER.pack(MAGIC, self.id_bytes, self.docs, self.tokens, *index, *where, 0)[:-4]
        self.put(footer + struct.pack("<I", zlib.crc32(footer)))


class Shard:
    """A shard file, read through a random-access file object."""

    def __init__(self, file):
        self.file = file
        footer = self.read(file.size() - FOOTER.size, FOOTER.size)
        magic, self.id_bytes, self.docs, self.tokens, i, n, b, m, crc = FOOTER.unpack(footer)
        if magic != MAGIC or crc != zlib.crc32(footer[:-4]):
            raise ValueError("not a whole shard")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.index = list(INDEX_ENTRY.iter_unpack(self.unpack(self.read(i, n))))
        self.bloom = self.read(b, m)

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, crc = self.index[k]
        data = self.read(offset, length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unpack(data), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield doc_id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id in the shard."""
        key, bits = key_of(doc_id), 8 * len(self.bloom)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in places(key, bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block that begins with the key or above
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for k in range(max(low - 1, 0), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [self.ids(value) for other, value in self.block(k) if other == key]
        return found


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """The ids of `docs` (doc_id, text) as shards in `folder`, a URI; returns their manifest, ordered by `shard`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer)
        id_bytes = 2 if max(encode.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        name, writer = f"{root}/.{shard}-{context.taskAttemptId()}", None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                if writer is None and len(part):
                    file = fs.open_output_stream(name)
                    writer = ShardWriter(file, id_bytes)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode.encode(part["text"].to_pylist()), strict=True):
                    writer.add(key_of(doc_id), ids + end)
        if writer:
            writer.close()
            file.close()
            fs.move(name, f"{root}/{shard:08d}.sst")
            row = [[shard], [f"{folder}/{shard:08d}.sst"], [writer.docs], [writer.tokens], [writer.at]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *(pa.array(x, pa.int64()) for x in row[2:])], names=["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    spread = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = spread.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id").select("doc_id", "text")
    return saved(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(shard, ordinal, doc_id, start, ids) of every document of the shards, `start` within all of them."""
    total = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("start", F.coalesce(total, F.lit(0)))  # one row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(path) as file:
                    shard, start, ordinal = Shard(file), row["start"], 0
                    for k in range(len(shard.index)):
                        entries = list(shard.block(k))
                        ids = [shard.ids(v) for _, v in entries]
                        sizes = np.array([len(x) for x in ids], np.int64)
                        ends = np.concatenate([[0], np.cumsum(sizes)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(ids), row["shard"], np.int32)),
                                pa.array(np.arange(ordinal, ordinal + len(ids), dtype=np.int64)),
                                pa.array([doc_id_of(key) for key, _ in entries], pa.int64()),
                                pa.array(start + ends[:-1]),
                                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                            ],
                            names=["shard", "ordinal", "doc_id", "start", "ids"],
                        )
                        start, ordinal = start + int(ends[-1]), ordinal + len(ids)

    # A task each: by size alone, adaptive execution would let one task read many.
    return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(read, "shard int, ordinal long, doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "shards"))
    return read_shards(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
