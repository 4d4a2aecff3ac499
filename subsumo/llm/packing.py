"""Operator 9: packing documents into sequences by patterns fitted with non-negative least squares.

Documents become ids with an end id and are cut into pieces of at most `capacity` ids. What is planned is the histogram
of piece lengths, at most `capacity` numbers, whatever the number of rows: lengths are rounded up to a grid, patterns of
up to PATTERN_DOCUMENTS grid lengths that fill a sequence (and of equal lengths and what they leave) are enumerated, and
repeat counts are fitted to the histogram by non-negative least squares and rounded. Patterns are then carried out on the true lengths:
the longest of each grid length, for the last one whatever fits best, then anything that still fits; what would stay
loosely filled is left for the residual. The residual is packed longest first, each sequence filled with the longest piece that
fits. Several shares of the fitted repeats are tried, and the plan with the fewest sequences is taken. Equal sequences are
planned at once, hence a step uses up a length or ends a pattern.

The plan maps (length, rank among pieces of this length) to a sequence and a place; ranks come from counts by stored
partition and length and a window over one partition and length, so that a common length is spread over tasks.

Null texts are empty: they consist of the end id. Repeated rows are packed each on its own; with a null doc_id too; ties
are ranked in any order; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .library import encoder

CAPACITY = 4096
END_ID = 1
#: Lengths of the grid, and the most documents of an enumerated pattern.
GRID, PATTERN_DOCUMENTS = 64, 4
#: Shares of the fitted repeats that are tried: with all carried out, the residual may lack short pieces to fill up its sequences.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: A pattern's sequence that stays emptier than this share is not carried out.
LOOSE = 1 / 512


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) from `docs` (doc_id, text); `ids`: little-endian 32-bit integers."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = [], [], [], [], []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode.encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        for column, value in zip(rows, (doc_id, k, start // 4, len(piece) // 4, piece), strict=True):
                            column.append(value)
                kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary")


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-10:
            break
        free[j] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 1e-12)
            if not low.any():
                x = z
                break
            ratio = np.full(len(x), np.inf)
            ratio[low] = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + min(1.0, ratio.min()) * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(grid: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of at most `most` grid lengths, longest first, that sum to `grid`; and equal ones with what they leave."""
    found = {(grid,)}
    for n in range(2, most + 1):
        for rest in combinations_with_replacement(range(grid - 1, 0, -1), n - 1):
            last = grid - sum(rest)
            if 0 < last <= rest[-1]:
                found.add((*rest, last))
    for b in range(1, grid):
        n, left = divmod(grid, b)
        found.add((b,) * n + ((left,) if left else ()))
    return sorted(found, reverse=True)


class Plan:
    """Runs of equal sequences: `add` takes the lengths of one and how many there are."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c}
        self.mask = sum(1 << n for n in self.left)
        self.taken: Counter[int] = Counter()
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.sequences = 0
        #: Sequences that patterns made.
        self.fitted = 0

    def longest(self, most: int, used: Counter[int]) -> int:
        """The longest length of which more are left than `used`, at most `most`; 0 if none."""
        mask = self.mask & ((1 << (most + 1)) - 1)
        while mask:
            n = mask.bit_length() - 1
            if self.left[n] > used[n]:
                return n
            mask ^= 1 << n
        return 0

    def add(self, lengths: list[int], most: int) -> int:
        """As many such sequences as there are pieces for, at most `most`."""
        times = min(most, *(self.left[n] // k for n, k in Counter(lengths).items()))
        offset = 0
        for n in lengths:
            self.rows.append((n, self.taken[n], self.sequences, offset))
            self.taken[n] += times
            self.left[n] -= times
            if not self.left[n]:
                self.mask ^= 1 << n
            offset += n
        self.sequences += times
        return times

    def fill(self, lengths: list[int], capacity: int) -> list[int]:
        used, room = Counter(lengths), capacity - sum(lengths)
        while room and (n := self.longest(room, used)):
            lengths.append(n)
            used[n] += 1
            room -= n
        return lengths

    def placed(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 4)


def fitted(counts: dict[int, int], capacity: int, grid: int, most: int) -> tuple[int, list[tuple[tuple[int, ...], float]]]:
    """The width of a grid cell, and patterns of grid lengths with their fitted repeats, the most repeated first."""
    grid = min(grid, capacity)
    cell = -(-capacity // grid)
    by_cell = np.bincount([-(-n // cell) for n in counts], weights=list(counts.values()), minlength=grid + 1)[1:] if counts else np.zeros(grid)
    total = by_cell.sum()
    if not total:
        return cell, []
    found = patterns(capacity // cell, most)
    a = np.zeros((len(by_cell), len(found)))
    for j, p in enumerate(found):
        for b in p:
            a[b - 1, j] += 1
    repeats = nnls(a, by_cell / total) * total
    return cell, [(found[j], float(repeats[j])) for j in sorted(np.flatnonzero(repeats > 0.5), key=lambda j: (-repeats[j], j))]


def carried_out(counts: dict[int, int], capacity: int, cell: int, fit: list[tuple[tuple[int, ...], float]], share: float) -> Plan:
    """A plan of this share of the fitted repeats, as far as they give well filled sequences, and of the residual."""
    made, loose = Plan(counts), int(capacity * LOOSE)
    if made.left.get(capacity):
        made.add([capacity], made.left[capacity])
    for pattern, repeats in fit if share else ():
        todo = round(repeats * share)
        while todo > 0:
            lengths: list[int] = []
            used: Counter[int] = Counter()
            for b in pattern[:-1]:
                n = made.longest(b * cell, used)
                if n <= (b - 1) * cell:  # none of this grid length is left
                    break
                lengths.append(n)
                used[n] += 1
            else:
                if lengths or made.longest(capacity, used) > (pattern[0] - 1) * cell:
                    lengths = made.fill(lengths, capacity)
                    if capacity - sum(lengths) <= loose:  # otherwise its pieces stay for the residual
                        todo -= made.add(lengths, todo)
                        continue
            break
    made.fitted = made.sequences
    while made.mask:
        made.add(made.fill([], capacity), 1 << 62)
    return made


def plan(counts: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, most: int = PATTERN_DOCUMENTS) -> Plan:
    """The plan with the fewest sequences among SHARES of the fit, the largest share if several have as few.

    Without any pattern the residual is all there is, and packing it longest first is first-fit decreasing: no plan is worse.
    """
    cell, fit = fitted({n: c for n, c in counts.items() if c and n < capacity}, capacity, grid, most)
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for share in SHARES:
        made = carried_out(counts, capacity, cell, fit, share)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences == least:
            break
    return best


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with its column `part` replaced by `rank`, from 0, among those of the same length."""
    counts = pieces.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "part", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start"))
    return pieces.withColumn("n", within).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("n") - 1).drop("part", "n", "base")


def place(length: Column, rank: Column, rows: np.ndarray) -> Column:
    """struct<sequence_id,offset> of the piece with this length and rank, by the plan's rows."""
    limit = 1 << 48
    keys = rows[:, 0] * limit + rows[:, 1]

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def look_up(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        row = rows[np.searchsorted(keys, n * limit + r, side="right") - 1] if len(n) else rows[:0]
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + r - row[:, 1]), pa.array(np.ascontiguousarray(row[:, 3]))], ["sequence_id", "offset"])

    return look_up(length, rank)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, start, length, ...) with sequence_id and offset."""
    kept = saved(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    made = plan({r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}, capacity)  # `capacity` rows at most
    at = place(F.col("length"), F.col("rank"), made.placed())
    return ranked(kept).withColumn("at", at).select(*pieces.columns, "at.sequence_id", "at.offset")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of `docs` with a digest of their ids and their places."""
    import public_tokenizers

    pieces = cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
