"""Operator 5: exact top-k search by inner product over norm-sorted vectors.

Components become integers. Candidates are sorted by descending length and packed into blocks; queries into blocks of
their own, a copy of which goes to every candidate block (the queries are a stated hundredth of the rows). A task holds
one candidate block and streams query blocks past it. Within a block, slices of falling length are scored as far as
they must be: a slice whose largest length times a query's length stays below the query's tenth best score so far is
skipped for it (Cauchy-Schwarz); otherwise the first HEAD components of the vectors, rotated by the right singular vectors of the
whole table so that they hold most of the length, plus the product of the residual lengths bound the score; what may reach
the tenth best is scored exactly in integers. A first pass over the longest block gives every query its
starting bound.

Vectors null or with null or non-finite components take no part, nor do rows without vec_id. Rows that repeat a vec_id are
rows of their own: each is a candidate of the others, and each a query if its id makes it one. Scores are exact; a component or
score beyond 64 bits counts as the nearest 64-bit integer. Missing trailing components count as zero. Ties go to the smaller
vec_id. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

K, SCALE, EVERY = 10, 1024, 100
BLOCK, QUERIES, SLICE, HEAD = 8192, 2048, 1024, 16
#: Integers up to this size are exact in doubles.
EXACT = 2.0**53
RESULT = "row long, query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<bigint>, norm2) of the usable rows of `vectors` (vec_id, embedding); `row` numbers them."""
    # The largest double below 2 ** 63.
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(2.0**63 - 1024)), F.lit(-(2.0**63)))).cast("long"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    usable = vectors.where("vec_id is not null and embedding is not null").where(F.coalesce(finite, F.lit(False)))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("v")).withColumn("norm2", norm2)


def below(scores: np.ndarray) -> np.ndarray:
    """Doubles that no score exceeds downwards: a double may be above a large integer."""
    near = scores.astype(float)
    return np.where(np.abs(near) < EXACT, near, np.nextafter(near, -np.inf))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, from the sums of their outer products; largest singular value first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch["v"], width).astype(float)
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "g"])

    rows = vectors.select("v").mapInArrow(sums, "i long, g array<double>").groupBy("i").agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(width)]).collect()
    gram = np.zeros((width, width))
    for r in rows:  # `width` rows
        gram[r["i"]] = r[1:]
    return np.linalg.eigh(gram)[1][:, ::-1]


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """Row number and vec_id of each row."""
    return np.column_stack([batch["row"].to_numpy(), batch["vec_id"].to_numpy()])


def blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(block, n, ids, ints): rows in their order, up to `size` to a block; blocks are numbered in the order of partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, ints, n = [], [], 0

        def block() -> pa.RecordBatch:
            data = [[number], [n], [np.vstack(ids).astype("<i8").tobytes()], [np.vstack(ints).astype("<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(data[0], pa.int64()), pa.array(data[1], pa.int64()), pa.array(data[2], pa.binary()), pa.array(data[3], pa.binary())], names=["block", "n", "ids", "ints"])

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, size - n)
                ids.append(rows_of(part))
                ints.append(matrix(part["v"], width))
                n, at = n + len(part), at + len(part)
                if n == size:
                    yield block()
                    ids, ints, n, number = [], [], 0, number + 1
        if n:
            yield block()

    return rows.select("row", "vec_id", "v").mapInArrow(pack, "block long, n long, ids binary, ints binary")


class Candidates:
    """A block of candidates, longest first, prepared for pruned scoring."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, rotated_by: np.ndarray):
        self.rows, self.ids = ids[:, 0], ids[:, 1]
        self.whole, self.ints = ints, ints.astype(float)
        self.norms = np.sqrt((self.ints**2).sum(1))
        self.rotated_by = rotated_by
        self.head = self.ints @ rotated_by[:, :HEAD]
        self.rest = np.sqrt(np.maximum(self.norms**2 - (self.head**2).sum(1), 0))
        self.exact = len(ids) == 0 or self.norms.max() ** 2 < EXACT

    def scores(self, queries: np.ndarray, part: slice | np.ndarray) -> np.ndarray:
        if self.exact and (queries.astype(float) ** 2).sum(1).max(initial=0) < EXACT:
            return (queries.astype(float) @ self.ints[part].T).astype(np.int64)
        if np.sqrt((queries.astype(float) ** 2).sum(1).max(initial=0)) * self.norms.max(initial=0) < 2.0**62:
            return queries @ self.whole[part].T
        large = np.iinfo(np.int64)
        return np.clip(queries.astype(object) @ self.whole[part].astype(object).T, large.min, large.max).astype(np.int64)

    def search(self, query_rows: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of all that can be among the k best, given that k others reach `bound`."""
        bound = bound.copy()
        norms = np.sqrt((queries.astype(float) ** 2).sum(1))
        head = queries.astype(float) @ self.rotated_by[:, :HEAD]
        rest = np.sqrt(np.maximum(norms**2 - (head**2).sum(1), 0))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(self.ids), SLICE):
            part = slice(at, min(at + SLICE, len(self.ids)))
            longest = self.norms[part].max()
            slack = 1e-9 * (norms * longest + 1)
            open_ = np.flatnonzero(norms * longest + slack >= bound)
            if not len(open_):
                continue
            cap = head[open_] @ self.head[part].T + rest[open_, None] * self.rest[part]
            may = cap + slack[open_, None] >= bound[open_, None]
            live = np.flatnonzero(may.any(0))
            rows = np.flatnonzero(may.any(1))
            if not len(live):
                continue
            found = self.scores(queries[open_[rows]], at + live)
            ok = may[np.ix_(rows, live)] & (self.rows[at + live] != query_rows[open_[rows], None])
            low = np.iinfo(np.int64).min
            if found.shape[1] > k:
                tenth = np.partition(np.where(ok, found, low), found.shape[1] - k, axis=1)[:, found.shape[1] - k]
                ok &= found >= tenth[:, None]
            ok &= found >= np.ceil(bound[open_[rows], None].clip(-(2.0**63), 2.0**63 - 1024)).astype(np.int64)
            i, j = np.nonzero(ok)
            merged = np.concatenate([best[0], open_[rows[i]]]), np.concatenate([best[1], self.ids[at + live[j]]]), np.concatenate([best[2], found[i, j]])
            order = np.lexsort((merged[1], -merged[2], merged[0]))
            q = merged[0][order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = tuple(x[order[rank < k]] for x in merged)
            last = rank == k - 1
            bound[q[last]] = np.maximum(bound[q[last]], below(merged[2][order[last]]))
        return best


def block_of(ids: bytes, ints: bytes, rotated_by: np.ndarray) -> Candidates:
    return Candidates(np.frombuffer(ids, "<i8").reshape(-1, 2), np.frombuffer(ints, "<i8").reshape(-1, len(rotated_by)), rotated_by)


def seeded(queries: DataFrame, longest: tuple[bytes, bytes], rotated_by: np.ndarray, k: int = K) -> DataFrame:
    """Query blocks (ids, ints, bound, seeds): `seeds` are the best of the longest candidate block, `bound` the k-th of their scores."""
    width = len(rotated_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block_of(*longest, rotated_by)
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                part = batch.slice(at, QUERIES)
                ids, ints = rows_of(part), matrix(part["v"], width)
                q, vec, score = held.search(ids[:, 0], ints, np.full(len(ids), -np.inf), k)
                bound = np.full(len(ids), -np.inf)
                full, first = np.unique(q, return_index=True)
                last = first + np.bincount(q, minlength=len(ids))[full] - 1
                whole = last - first == k - 1
                bound[full[whole]] = below(score[last[whole]])
                seeds = [{"row": r, "query_id": a, "vec_id": b, "score": c} for (r, a), b, c in zip(ids[q].tolist(), vec.tolist(), score.tolist(), strict=True)]
                data = [ids.astype("<i8").tobytes()], [ints.astype("<i8").tobytes()], [bound.astype("<f8").tobytes()], [seeds]
                kinds = pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([(n, pa.int64()) for n in ("row", "query_id", "vec_id", "score")]))
                yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], names=["ids", "ints", "bound", "seeds"])

    return queries.select("row", "vec_id", "v").mapInArrow(run, "ids binary, ints binary, bound binary, seeds array<struct<row:long,query_id:long,vec_id:long,score:long>>")


def search(candidates: DataFrame, n_blocks: int, queries: DataFrame, rotated_by: np.ndarray, k: int = K) -> DataFrame:
    """(query_id, vec_id, score) of at most k of each candidate block but the longest for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = of = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bound"] is None:
                    held, of = block_of(row["ids"], row["ints"], rotated_by), row["number"]
                    continue
                assert of == row["number"], "a query block comes after its candidates"
                ids = np.frombuffer(row["ids"], "<i8").reshape(-1, 2)
                ints = np.frombuffer(row["ints"], "<i8").reshape(len(ids), -1)
                q, vec, score = held.search(ids[:, 0], ints, np.frombuffer(row["bound"], "<f8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q, 0]), pa.array(ids[q, 1]), pa.array(vec), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    left = candidates.where("number > 0").select("number", "ids", "ints", F.lit(None).cast("binary").alias("bound"))
    right = queries.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("number"), "ids", "ints", "bound")
    both = left.unionByName(right).repartition(n_blocks, "number").sortWithinPartitions("number", F.col("bound").isNotNull())
    return both.mapInArrow(run, RESULT)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors of `vectors` (vec_id, embedding) whose id is divisible by `every`."""
    usable = saved(integers(vectors.select("vec_id", "embedding")), "vectors")
    width = usable.agg(F.max(F.size("v"))).first()[0] or 1
    rotated_by = rotation(usable, width)
    ordered = usable.repartitionByRange(F.desc("norm2"), "vec_id", "row").sortWithinPartitions(F.desc("norm2"), "vec_id", "row")
    packed = saved(blocks(ordered, BLOCK, width), "blocks")
    numbered = packed.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("number"))  # a row a block
    candidates = packed.join(numbered, "block")
    first = candidates.where("number = 0").select("ids", "ints").first()  # a block's size is bounded
    longest = (bytes(first.ids), bytes(first.ints)) if first else (b"", b"")
    queries = saved(seeded(usable.where(F.col("vec_id") % every == 0), longest, rotated_by, k), "queries")
    found = queries.select(F.inline("seeds"))
    n_blocks = packed.count()
    if n_blocks > 1:
        found = found.unionByName(search(candidates, n_blocks, queries, rotated_by, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
