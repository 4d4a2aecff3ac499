"""Captures, their support, and the groups of captures that share a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import BITS, CHARS, VALID, codes_of, condition, first_sub, projected, second_sub, size
from ..storage import saved, saved_parts
from .conditions import structs, unary_conditions
from .dictionary import decompress

CAPTURE = ["code", "v1", "v2"]

UNARY, BINARY = ([c for c in VALID if (c & 7).bit_count() == n] for n in (1, 2))


def captures(triples: DataFrame, projection: str = "spo") -> DataFrame:
    """Distinct (value, code, v1, v2): `value` is in the extension of the capture; v2 is '' for unary ones."""
    rows = []
    for code in codes_of(projection):
        bits = [b for b in (1, 2, 4) if code & b]
        rows.append((F.col(CHARS[code >> 3]), code, *[F.col(CHARS[b]) for b in bits], *[""] * (2 - len(bits))))
    return triples.select(F.inline(structs(rows, ("value", *CAPTURE)))).distinct()


def capture_support(captures: DataFrame, support: int) -> DataFrame:
    """(code, v1, v2, support): extensions of at least `support` values."""
    return captures.groupBy(*CAPTURE).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)


class Encoded:
    """Distinct triples with the ids of their frequent unary conditions (us, up, uo; null where infrequent).

    A capture has no more values than its conditions have triples, so that only these conditions can make frequent captures:
    infrequent ones never become rows. `unary`: (uid, value, count) by type. `attributes`: those whose conditions are needed.
    """

    def __init__(self, triples: DataFrame, support: int, attributes: str = "spo"):
        self.support = support
        counted = unary_conditions(triples.select(*"spo"), support).withColumn("uid", F.monotonically_increasing_id())
        self.unary = saved_parts(counted, "unary", "type")
        self.none = counted.drop("type").where("false")
        rows = triples.select(*"spo")
        for attribute in "spo":
            part = self.unary.get(BITS[attribute]) if attribute in attributes else None
            if part is None:
                rows = rows.withColumn(f"u{attribute}", F.lit(None).cast("long"))
            else:
                rows = rows.join(part.select(F.col("value").alias(attribute), F.col("uid").alias(f"u{attribute}")), attribute, "left")
        self.triples = saved(rows.where("us is not null or up is not null or uo is not null"), "encoded")

    def conditions(self) -> DataFrame:
        """(uid, value, count) of every type."""
        out = self.none
        for part in self.unary.values():
            out = out.unionByName(part)
        return out

    def rows(self, codes: list[int], distinct: bool) -> DataFrame:
        """(value, code, a, b) of the captures of `codes` with frequent conditions; b is null for unary ones."""
        made = []
        for code in codes:
            ids = [F.col(f"u{CHARS[b]}") for b in (1, 2, 4) if code & b]
            made.append((F.col(CHARS[code >> 3]), code, *ids, *[F.lit(None).cast("long")] * (2 - len(ids))))
        rows = self.triples.select(F.inline(structs(made, ("value", "code", "a", "b"))))
        rows = rows.where("a is not null and (b is not null or code not in ({}))".format(",".join(map(str, BINARY))))
        return rows.distinct() if distinct else rows


def supports(rows: DataFrame, support: int) -> DataFrame:
    """(code, a, b, support, x, y) of frequent captures; x and y: two 64-bit hashes of the extension as a set."""
    hashes = [F.bit_xor(F.xxhash64("value")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("value"))).alias("y")]
    return rows.groupBy("code", "a", "b").agg(F.count(F.lit(1)).alias("support"), *hashes).where(F.col("support") >= support)


class Groups:
    """Frequent captures under ids, their classes of equal extension, and the classes by value: what the pair operators shuffle.

    `frequent`: (id, cls, code, a, b, v1, v2, support, first, second). Captures whose extensions are equal have one class, named by one
    of its captures, a unary one if there is any; dependencies and overlaps of a class are those of all its captures. Extensions count
    as equal with the same number of values and the same 128 bits of exclusive-or hashes: among a billion captures, a wrong match has
    a chance of about 1e-21. `first` and `second`: the ids of the unary parts of a binary capture, which are as frequent.
    `members`: (value, id, support, size) of the captures that name classes; size: 1 for unary, 2 for binary.
    `use_rules`: without the binary captures whose conditions are the two sides of a perfect rule.
    """

    def __init__(self, triples: DataFrame, support: int, projection: str = "spo", use_rules: bool = False, entries: DataFrame | None = None):
        """`triples` are distinct; `entries` (hash, value) give the values of the names if triples are compressed."""
        self.min_support = support
        self.entries = entries
        codes = codes_of(projection)
        conditions = "".join(c for c in "spo" if use_rules or any(code & BITS[c] for code in codes))
        self.encoded = Encoded(triples, support, conditions)
        unary = saved(self.encoded.rows([c for c in codes if c in UNARY], distinct=True), "unary-rows")
        # A binary capture has one value for each of its distinct triples.
        pairs = supports(self.encoded.rows(BINARY if use_rules else [c for c in codes if c in BINARY], distinct=False), support)
        if use_rules:
            pairs = saved(self.with_counts(pairs), "pairs")
            self.rules = pairs.where("support = a_count").selectExpr("a as ante", "b as cons").unionByName(pairs.where("support = b_count").selectExpr("b as ante", "a as cons"))
            pairs = pairs.where("support <> a_count and support <> b_count").where(F.col("code").isin(codes)).drop("a_count", "b_count")
        found = supports(unary, support).unionByName(pairs)
        found = saved(found.select(F.monotonically_increasing_id().alias("id"), "*"), "numbered")
        self.frequent = saved(self.classed(found), "frequent")
        reps = self.frequent.where("id = cls").select("id", "code", "a", "b", "support", size(F.col("code")).alias("size"))
        one = unary.drop("b").join(reps.where("size = 1").drop("b"), ["code", "a"])
        two = self.encoded.rows([c for c in codes if c in BINARY], distinct=False).join(reps.where("size = 2"), ["code", "a", "b"])
        picked = ["value", "id", "support", "size"]
        self.members = saved(one.select(picked).unionByName(two.select(picked)), "groups")

    def with_counts(self, pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(self.encoded.conditions().select(F.col("uid").alias(side), F.col("count").alias(f"{side}_count")), side)
        return pairs

    def classed(self, found: DataFrame) -> DataFrame:
        same = ["support", "x", "y"]
        classes = found.groupBy(*same).agg(F.min(F.struct(size(F.col("code")).alias("size"), "id")).alias("least")).select(*same, F.col("least.id").alias("cls"))
        out = found.join(classes, same).drop("x", "y")
        names = self.encoded.conditions()
        if self.entries is not None:
            names = decompress(names, ["value"], self.entries)
        out = out.join(names.select(F.col("uid").alias("a"), F.col("value").alias("v1")), "a").join(names.select(F.col("uid").alias("b"), F.col("value").alias("v2")), "b", "left")
        one = found.where(size(F.col("code")) == 1)
        for side, part, name in (("a", first_sub, "first"), ("b", second_sub, "second")):
            parts = one.select(F.col("code").alias("part"), F.col("a").alias("part_uid"), F.col("id").alias(name))
            is_part = (F.when(size(F.col("code")) == 2, part(F.col("code"))) == F.col("part")) & (F.col(side) == F.col("part_uid"))
            out = out.join(parts, is_part, "left").drop("part", "part_uid")
        return out.select("id", "cls", "code", "a", "b", "v1", F.coalesce("v2", F.lit("")).alias("v2"), "support", "first", "second")

    def binary(self) -> DataFrame:
        """(id, first, second) of the binary captures."""
        return self.frequent.where("first is not null").select("id", "first", "second")

    def parts(self) -> DataFrame:
        """(id, part): binary captures and each of their unary parts."""
        return self.binary().select("id", F.explode(F.array("first", "second")).alias("part"))

    def sizes(self) -> DataFrame:
        return self.members.groupBy("value").agg(F.count(F.lit(1)).alias("size"))

    def side(self, prefix: str, key: str, name: str, *more: str) -> DataFrame:
        """Captures with their names as (c, 1, 2) after `prefix`, and the column `key` as `name`."""
        return self.frequent.select(F.col(key).alias(name), *more, F.col("code").alias(f"{prefix}c"), F.col("v1").alias(f"{prefix}1"), F.col("v2").alias(f"{prefix}2"))

    def named(self, pairs: DataFrame) -> DataFrame:
        """`pairs` with ids a and b as captures (dc, d1, d2) and (rc, r1, r2)."""
        return pairs.join(self.side("d", "id", "a"), "a").join(self.side("r", "id", "b"), "b")

    def unary_of(self) -> DataFrame:
        """(id, proj, cond) of the unary captures."""
        return self.frequent.where("first is null").select("id", projected(F.col("code")).alias("proj"), condition(F.col("code")).alias("cond"))
