"""Operator 3: n-gram Jaccard join by a partition of the token universe.

Documents are sets of distinct word 3-shingles; two link where 100 |A & B| >= 90 |A | B|. Sets fall into bands by size.
For the pairs whose smaller set lies in a band, the universe of (hashed) shingles is cut into m segments by hash, and a
segment i allows b_i - 1 errors with b_i in {1, 2} and sum b_i >= H + 1, where H is the most elements in which two
linked sets of these sizes differ. By the pigeonhole principle linked sets agree in some segment with b = 1, or differ by
one element at most in one with b = 2. Keys are the subsets of the segments, and for b = 2 their one-deletion
neighbourhoods too. How many segments of either kind a band has is allocated by a cost model (rows written, chance
partners): short sets get few segments with deletions, long ones many exact ones.

Equal word sequences are one class, joined through its representative. In the group of a key every member is compared
with a pivot only, and the links found merge members into components. Groups that share members form families. A family that
holds several components is decided within one task if it is bounded: the sets of all but its largest component are
compared with all by products of their incidence matrix. In larger families further pivots of each group (of its rarest
components first) meet the other members in rounds, until every group's members are in one component or compared with
each other. So all pairs that a key brings together are decided, but a group of copies costs one comparison each.
A pair is verified on the shingles of its texts.

Width and threshold are a `Rule`; the query has three words and 90. Below SEGMENTS linked sets may differ so much that segments
hold few elements, some none and some only common ones. There the universe is cut into more segments than the pigeonhole
principle asks for, and each set takes the cheapest of its own in an order that all sets share: those with most rare shingles
first, empty ones last. The first H + 1 of linked sets share one (`tokens`). Pairs meet a parity sketch before their texts do,
which rules out none that links.

Texts that are null or without words have no shingles and link with nothing. Components take the smallest non-null
doc_id (null if all are null); rows that repeat a doc_id stay. Extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, saved, table
from .components import components

#: Links are 100 * intersection >= LEAST * union.
LEAST = 90
WIDTH = 3
#: From this threshold on sets have keys of all segments, below of the cheapest ones.
SEGMENTS = 90
#: One of SAMPLED documents is looked at for shingles that OFTEN of them or more have; the most frequent, up to COMMON, are put last.
SAMPLED, OFTEN, COMMON = 8, 3, 200_000
#: Bits of a sketch.
BITS = 1024
#: Chance that an element of a segment agrees in two unrelated sets, and the number of sets, of the cost model.
AGREEMENT, PARTNERS = 0.3, 1e4
#: Below SEGMENTS: segments without deletions, in hundredths of those that the pigeonhole principle asks for.
CHOICE = 125
#: Families of up to SMALL members with ELEMENTS shingles in all are decided within a task after the first round; in the
#: groups of larger ones PIVOTS members a round meet the others.
SMALL, ELEMENTS, PIVOTS = 4096, 2_000_000, 256
#: Rows and columns of the incidence matrix that are multiplied at once.
ROWS, COLUMNS = 512, 1024
#: Up to so many rows of ids (8 to 40 bytes each) are broadcast, so that keys and texts need no shuffle; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: The same of pairs of doc_id and digest (about 100 bytes each).
BROADCAST_PAIRS = 200_000

U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


class Rule(NamedTuple):
    """Sets of shingles of `width` words link where 100 * intersection >= least * union."""

    width: int = WIDTH
    least: int = LEAST


OWN = Rule()
#: Hashes of common shingles, ascending, and their ranks, the most frequent last.
Often = tuple[np.ndarray, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, rule: Rule = OWN) -> set:
    words = words_of(text)
    if len(words) < rule.width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(rule.width))))


def linked(a: set, b: set, rule: Rule = OWN) -> bool:
    common = len(a & b)
    return common > 0 and 100 * common >= rule.least * (len(a) + len(b) - common)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * M1
    h = (h ^ (h >> U64(27))) * M2
    return h ^ (h >> U64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=None)
def factors(width: int) -> np.ndarray:
    """Odd factors of the words of a shingle."""
    return np.concatenate([np.array([M1, M2, M3], U64), mixed(np.arange(3, width + 3, dtype=U64)) | U64(1)])


def hashed_set(words: list[bytes], rule: Rule = OWN) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    n, width = len(words), rule.width
    if not n:
        return np.zeros(0, U64)
    h = np.fromiter(map(held("word hashes", WordHashes).__getitem__, words), U64, n)
    if n < width:
        return mixed(np.array([(h * factors(width)[1 : n + 1]).sum(dtype=U64) + U64(n)], U64))
    turned, total = mixed(h), np.zeros(n - width + 1, U64)
    for i, factor in enumerate(factors(width)[:width]):
        total += (turned if i % 2 else h)[i : n - width + 1 + i] * factor
    return np.unique(mixed(total))


@lru_cache(maxsize=None)
def band(k: int, least: int = LEAST) -> tuple[int, int]:
    """Smallest and largest size of band k: three times the reach of a link."""
    low = 1 if k == 0 else band(k - 1, least)[1] + 1
    return low, max(low, low * 100**3 // least**3)


@lru_cache(maxsize=100_000)
def band_of(size: int, least: int = LEAST) -> int:
    k = 0
    while band(k, least)[1] < size:
        k += 1
    return k


def errors(size: int, least: int = LEAST) -> int:
    """Elements in which linked sets differ at most, the smaller of `size`: |A + B| - 2 |A & B|, with |B| <= 100 |A| / least."""
    return size * (100 - least) // least


def most_errors(k: int, least: int = LEAST) -> int:
    """The same, the smaller in band k."""
    return errors(band(k, least)[1], least)


@lru_cache(maxsize=None)
def allocation(k: int, rule: Rule = OWN) -> tuple[int, int]:
    """(segments, how many of them with deletions) of band k, the cheapest that the pigeonhole principle admits. Below SEGMENTS
    there are more segments without deletions than it asks for, of which each set takes its cheapest (`tokens`)."""
    need, (low, n) = most_errors(k, rule.least) + 1, band(k, rule.least)
    if rule.least >= SEGMENTS:

        def cost(deletions: int) -> float:
            m = need - deletions
            size = n / m
            rows = m - deletions + deletions * (1 + size)
            chance = (m - deletions) * AGREEMENT**size + deletions * (1 + size) * AGREEMENT ** max(size - 1, 0)
            return rows + PARTNERS * chance

        best = min(range(need // 2 + 1), key=cost)
        return need - best, best
    agreement = AGREEMENT ** ((rule.width - 1) / 2)

    def spare(deletions: int) -> int:
        return -(-(need - 2 * deletions) * CHOICE // 100)

    def expense(deletions: int) -> float:
        m = spare(deletions) + deletions
        size = n / m
        rows = need - 2 * deletions + deletions * (1 + size)
        # sizes of segments scatter: agreement ** size on the average; no taken one is empty, but one with deletions may be
        average = agreement ** (size - 1) if m == 1 else np.exp(-low / m * (1 - agreement)) / agreement
        return rows + PARTNERS * ((need - 2 * deletions) * agreement ** max(low / m, 1) + deletions * (1 + size) * average)

    best = min(range(need // 2 + 1), key=expense)
    return spare(best) + best, best


def keys(s: np.ndarray, k: int, rule: Rule = OWN, often: Often | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the set `s` (ascending hashes) for the pairs of band k: of its segments, and of their one-deletion neighbourhoods."""
    m, deletions = allocation(k, rule)
    segment = ((s >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
    g = mixed(s + M3)
    ends = np.searchsorted(segment, np.arange(m + 1))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(g, dtype=U64)])[ends]
    subset = sums[1:] - sums[:-1]
    salt = mixed(np.arange(m, dtype=U64) * M2 + np.full(1, k, U64) * M1 + M3)
    exact = mixed(subset * M3 + salt)
    at = segment[: ends[deletions]]
    deleted = mixed((subset[at] - g[: len(at)]) * M3 + salt[at]) if deletions else np.zeros(0, U64)
    if often is not None:
        differ = errors(min(len(s), band(k, rule.least)[1]), rule.least)
        exact = np.concatenate([exact[:deletions], tokens(s, segment, exact, deletions, differ + 1 - 2 * deletions, often)])
    return exact, deleted


def tokens(s: np.ndarray, segment: np.ndarray, exact: np.ndarray, deletions: int, count: int, often: Often) -> np.ndarray:
    """The `count` cheapest keys of the segments without deletions: those with most elements outside `often` first, then by the
    rarest element, the empty ones last.

    The order depends on a segment's content alone, so it is the same for all sets. Where linked sets differ in fewer than
    `count` of these segments, each has fewer than `count` contents that the other lacks, and the first `count` of both share
    one: the earlier of the two ends of these beginnings lies within the other's, and one content up to it is common.
    """
    common, rank = often
    m, order = len(exact), np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        order = np.where(common[at] == s, rank[at], 0)
    rare = np.bincount(segment[order == 0], minlength=m)
    lowest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(lowest, segment, order)
    chosen = np.lexsort((exact, lowest, -rare))
    return exact[chosen[chosen >= deletions][: max(count, 0)]]


def all_keys(s: np.ndarray, rule: Rule = OWN, often: Often | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = len(s)
    if not n:
        return np.zeros(0, U64), np.zeros(0, U64)
    k = band_of(n, rule.least)
    found = [keys(s, k, rule, often)]
    if k and rule.least * n <= 100 * band(k - 1, rule.least)[1]:
        found.append(keys(s, k - 1, rule, often))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def prefix(s: np.ndarray, rule: Rule, common: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The first elements of the set `s` (ascending hashes), those in `common` (ascending too) last, by `rank` if given;
    linked sets share one. Keys no longer use it; tests state this bound."""
    n = len(s)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        often = common[at] == s
        last = s[often] if rank is None else s[often][np.argsort(rank[at[often]])]
        s = np.concatenate([s[~often], last])
    return s[: n - (rule.least * n + 99) // 100 + 1]


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements that fall on each of BITS bits. The bits in which two sketches differ are no more than the
    elements in which the sets do."""
    return np.packbits(np.bincount((s & U64(BITS - 1)).astype(np.int64), minlength=BITS) % 2 == 1).tobytes()


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U64), *arrays]).view(np.int64)))


def common_shingles(docs: DataFrame, rule: Rule) -> Often:
    """Shingles (hashes, ascending) that many documents have, and their ranks, the most frequent last. They settle the order
    of segments, hence work, not results. Whole sets are counted: with common shingles last, any other may come first."""

    @F.arrow_udf("array<long>")
    def every(texts: pa.Array) -> pa.Array:
        return lists([hashed_set(words_of(t.as_py()), rule) for t in texts])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select(F.explode(every("text")).alias("key"))
    often = sample.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN)
    found = often.orderBy(F.desc("c"), "key").limit(COMMON).select("key").toArrow()  # eight bytes each
    hashes = found["key"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(hashes)
    return hashes[order], len(order) - order


FACTS = "struct<digest:binary,n:int,exact:array<long>,deleted:array<long>,sketch:binary>"


def facts(text: Column, rule: Rule = OWN, often: Often | None = None) -> Column:
    """Digest of the word sequence, size of the set, and its keys; of the cheapest segments where `often` is given, with a sketch."""

    @F.arrow_udf(FACTS)
    def measure(texts: pa.Array) -> pa.Array:
        digests, sizes, exact, deleted, sketches = [], [], [], [], []
        for text in (t.as_py() for t in texts):
            words = words_of(text)
            s = hashed_set(words, rule)
            e, d = all_keys(s, rule, often)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(s))
            exact.append(e)
            deleted.append(d)
            sketches.append(None if often is None else sketch(s))
        columns = pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists(exact), lists(deleted), pa.array(sketches, pa.binary())
        return pa.StructArray.from_arrays(columns, ["digest", "n", "exact", "deleted", "sketch"])

    return measure(text)


def text_digest(text: Column) -> Column:
    """The digest of the word sequence, as in FACTS."""

    @F.arrow_udf("binary")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in texts], pa.binary())

    return measure(text)


def verified(a: Column, b: Column, rule: Rule) -> Column:
    """Whether two texts link; rows should come ordered by `a`."""

    @F.arrow_udf("boolean")
    def verify(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, held = [], None, set()
        for x, y in ((a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)):
            if x != last:
                last, held = x, shingles(x, rule)
            out.append(linked(held, shingles(y, rule), rule))
        return pa.array(out, pa.bool_())

    return verify(a, b)


def narrow(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast up to `bound` rows. `ids` is stored, hence counting it is cheap."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def possible(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sketches (uid, n, sketch) admit a link."""

    @F.arrow_udf("int")
    def differing(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), np.int32)
        for at in range(0, len(left), ROWS):
            bits = [np.frombuffer(b"".join(x.slice(at, ROWS).to_pylist()), np.uint8).reshape(-1, BITS // 8) for x in (left, right)]
            out[at : at + ROWS] = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int32)
        return pa.array(out, pa.int32())

    # Left to Spark's size-checked broadcasts: a sketch is many times an id.
    left, right = (sketches.select(F.col("uid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("d", differing(F.col("sketch_a"), F.col("sketch_b")))
    return saved(both.where((100 + rule.least) * (F.col("n_a") + F.col("n_b") - F.col("d")) >= 2 * rule.least * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "possible")


def links_of(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link."""
    left, right = texts.select(F.col("uid").alias("a"), F.col("text").alias("left")), texts.select(F.col("uid").alias("b"), F.col("text").alias("right"))
    return saved(right.join(narrow(pairs), "b").join(left, "a").where(verified(F.col("left"), F.col("right"), rule)).select("a", "b"), "links")


def close(n: Column, other: Column, rule: Rule) -> Column:
    return rule.least * F.greatest(n, other) <= 100 * F.least(n, other)


def classes_of(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, digest, n, keys) of every row, and (cls, digest, doc_id) of every class of equal word sequences."""
    often = common_shingles(docs, rule) if rule.least < SEGMENTS else None
    rows = saved(docs.select("doc_id", facts(F.col("text"), rule, often).alias("f")).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "f.*"), "facts")
    return rows, saved(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("doc_id")), "classes")


def members_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, exact, uid, n) of the keys that several representatives share, one of them by a whole subset at least."""
    own = rows.join(narrow(classes.select(F.col("cls").alias("uid"))), "uid")
    tagged = F.concat(F.transform("exact", lambda k: F.struct(k.alias("key"), F.lit(True).alias("exact"))), F.transform("deleted", lambda k: F.struct(k.alias("key"), F.lit(False).alias("exact"))))
    every = own.select("uid", "n", F.explode(tagged).alias("t")).select("t.key", "t.exact", "uid", "n")
    # A key that only one row has is most common: counting first, with map-side combination where rows repeat, drops it.
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("exact").alias("e")).where("c > 1 and e").select("key")
    return saved(every.join(shared, "key"), "members")


def texts_of(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(uid, text) of the representatives in `members`."""
    wanted = saved(members.select("uid").distinct().join(classes.select(F.col("cls").alias("uid"), "digest", "doc_id"), "uid"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    near = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = saved(near.select("text", text_digest(F.col("text")).alias("digest")).join(narrow(wanted.select("uid", "digest")), "digest").select("uid", "text"), "texts")
    once = found.agg(F.count(F.lit(1)) == F.count_distinct("uid")).first()[0]
    return found if once else saved(found.groupBy("uid").agg(F.min("text").alias("text")), "texts")  # rows that repeat


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """`members` with the component of each; `found` (u, label) are the components of more than one."""
    out = members.join(narrow(found).withColumnRenamed("u", "uid"), "uid", "left")
    return out.withColumn("label", F.coalesce("label", "uid"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components `found` (u, label) after further `links` (a, b): only the components that these join are looked at again."""
    if links.isEmpty():
        return found
    ends = links.select(F.col("a").alias("u")).unionByName(links.select(F.col("b").alias("u"))).distinct()
    every = found.unionByName(ends.join(narrow(found), "u", "left_anti").select("u", F.col("u").alias("label")))
    a, b = (every.select(F.col("u").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
    joints = links.join(a, "a").join(b, "b").where("of_a <> of_b").select(F.col("of_a").alias("u"), F.col("of_b").alias("v"))
    moved = saved(components(joints), "moved").select(F.col("u").alias("label"), F.col("label").alias("to"))
    return saved(every.join(narrow(moved), "label", "left").select("u", F.coalesce("to", "label").alias("label")), "labels")


def unsettled(members: DataFrame) -> DataFrame:
    """The members of groups that hold several components, and a whole subset."""
    groups = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("exact").alias("e"))
    return saved(members.join(groups.where("low < high and e").select("key"), "key"), "unsettled")


def component_labels(docs: DataFrame, rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(u, label) of the representatives that link with another."""
    members = members_of(rows, classes)
    texts = texts_of(docs, members, classes)
    look = lambda pairs: pairs
    if rule.least < SEGMENTS:
        sketches = saved(rows.select("uid", "n", "sketch").join(members.select("uid").distinct(), "uid", "left_semi"), "sketches")
        look = lambda pairs: possible(pairs, sketches, rule)
    # First round: every member of a group with its pivot.
    pivot = members.groupBy("key").agg(F.min(F.struct(~F.col("exact"), F.col("uid"), F.col("n"))).alias("p"))
    first = members.join(pivot, "key").where(F.col("uid") != F.col("p.uid")).select(F.least("p.uid", "uid").alias("a"), F.greatest("p.uid", "uid").alias("b"), close(F.col("n"), F.col("p.n"), rule).alias("near"))
    met = saved(first.distinct(), "met")
    pairs = met.where("near").select("a", "b")
    links = links_of(look(pairs), texts, rule)
    # Every group lies in one family.
    families = components(met.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("uid"), F.col("label").alias("family"))
    found = saved(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    nodes = labelled(families.join(members.select("uid", "n").distinct(), "uid"), found)
    sizes = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = saved(sizes.where("low < high").select("family", ((F.col("size") <= SMALL) & (F.col("elements") <= ELEMENTS)).alias("small")), "sizes")
    nodes = saved(nodes.join(sizes, "family").select("family", "uid", "label", "small"), "nodes")
    found = merged(found, links_of(in_family_links(nodes.where("small"), texts, rule), texts, rule))
    large = nodes.where("not small").select("uid")
    if large.isEmpty():
        return found
    # Pivots have been compared with all others of their groups.
    rest = saved(members.join(large, "uid", "left_semi").join(pivot.select("key", F.col("p.uid").alias("uid")), ["key", "uid"], "left_anti"), "rest")
    done = pairs
    while True:
        open_ = unsettled(labelled(rest, found).select("key", "exact", "uid", "n", "label"))
        if open_.isEmpty():
            return found
        chosen = saved(pivots(open_), "pivots")
        a, b = chosen.select("key", *[F.col(c).alias(f"{c}_a") for c in ("exact", "uid", "n", "label")]), open_.select("key", *[F.col(c).alias(f"{c}_b") for c in ("exact", "uid", "n", "label")])
        found_pairs = a.join(b, "key").where("label_a <> label_b and (exact_a or exact_b)").where(close(F.col("n_a"), F.col("n_b"), rule))
        pairs = saved(found_pairs.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        done = saved(done.unionByName(pairs), "done")  # so that plans do not grow with the rounds
        found = merged(found, links_of(look(pairs), texts, rule))
        rest = saved(open_.join(chosen.select("key", "uid"), ["key", "uid"], "left_anti").select("key", "exact", "uid", "n"), "rest")


def spanning_links(sets: list[np.ndarray], labels: list[int], rule: Rule = OWN) -> list[tuple[int, int]]:
    """Links between sets (of hashes) that join components, at most one fewer than there are sets."""
    g = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.unique(labels, return_inverse=True)[1]
    strays = np.flatnonzero(label != np.bincount(label).argmax())  # pairs within the largest component need no look
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(g), sizes)
    shared = np.bincount(column) > 1  # others are in no intersection
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], int(shared.sum())
    ends = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found = []
    for at in range(0, len(strays), ROWS):
        mine = strays[at : at + ROWS]
        common = np.zeros((len(mine), g), np.float32)  # exact below 2**24
        for k, first in enumerate(range(0, width, COLUMNS)):
            part = np.zeros((g, min(COLUMNS, width - first)), np.float32)
            part[row[ends[k] : ends[k + 1]], column[ends[k] : ends[k + 1]] - first] = 1
            common += part[mine] @ part.T
        common = common.astype(np.float64)
        i, j = np.nonzero((100 * common >= rule.least * (sizes[mine][:, None] + sizes[None, :] - common)) & (label[mine][:, None] != label[None, :]))
        for x, y in zip(mine[i], j):
            p, q = find(labels[x]), find(labels[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((int(x), int(y)))
    return found


def in_family_links(nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links that join components within the families of `nodes` (family, uid, label), each decided by one task.

    Found on the shingles' hashes; the caller verifies what is found on the texts.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = [sorted((ids[x], ids[y])) for x, y in spanning_links(sets, labels, rule)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for family, uid, label, text in (row for at in range(0, len(batch), 256) for row in zip(*(batch[c].slice(at, 256).to_pylist() for c in ("family", "uid", "label", "text")), strict=True)):
                if family != now and ids:
                    yield found()
                    ids, labels, sets = [], [], []
                now = family
                ids.append(uid)
                labels.append(label)
                sets.append(hashed_set(words_of(text), rule))
        if ids:
            yield found()

    rows = texts.join(narrow(nodes.select("family", "uid", "label")), "uid").repartition("family").sortWithinPartitions("family")
    return saved(rows.mapInArrow(decide, "a long, b long").distinct(), "decided")


def pivots(large: DataFrame) -> DataFrame:
    """The first PIVOTS members of each group, those of its rarest components first: once they are compared with all
    others, a group of one large component and some strays is settled."""
    large = large.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("same", F.desc("exact"), "uid"))
    return large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank", "same")


def joined(docs: DataFrame, rule: Rule = OWN) -> DataFrame:
    """(uid, doc_id, digest, n_shingles, component, component_id) of every row of `docs` (doc_id, text).

    `digest` is of the word sequence; `component` a number of the component, null for texts without words.
    """
    docs = docs.select("doc_id", "text")
    rows, classes = classes_of(docs, rule)
    labels = component_labels(docs, rows, classes, rule)
    of_class = classes.join(labels.select(F.col("u").alias("cls"), "label"), "cls", "left").withColumn("component", F.coalesce("label", "cls"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(least, "component").select("digest", "component", "component_id")
    whole = rows.select("uid", "doc_id", "digest", F.col("n").cast("long").alias("n_shingles"))
    without = whole.where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return whole.where("n_shingles > 0").join(named, "digest").select(without.columns).unionByName(without)


def one_of_each(docs: DataFrame, rule: Rule = OWN) -> DataFrame:
    """The rows of `docs`, with its columns, of which no other document of their component has a smaller doc_id; of rows
    that repeat doc_id and words one stays. Texts without words stay."""
    found = saved(joined(docs, rule), "joined")
    grouped = found.where("component is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("f")).select("f.doc_id", "f.digest")
    pairs = grouped.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))
    kept = first.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    dropped = saved(pairs.join(kept, same, "left_anti").select(F.col("doc_id").alias("id"), F.col("digest").alias("d")), "dropped")
    repeated = saved(pairs.where("copies > 1").join(kept, same, "left_semi").select(F.col("doc_id").alias("id"), F.col("digest").alias("d")), "repeated")
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_digest(F.col("text")).alias("digest")
    rest = docs.select(row, "doc_id", key)
    rest = rest.join(narrow(dropped, BROADCAST_PAIRS), same, "left_anti")
    if not repeated.isEmpty():
        twice = rest.join(narrow(repeated, BROADCAST_PAIRS), same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rest = rest.join(narrow(repeated, BROADCAST_PAIRS), same, "left_anti").select("row").unionByName(twice.select("row"))
    return rest.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
