"""Pairs of captures: overlaps, dependencies, and candidates generated level by level.

Steps work on the ids of `Groups`; `Groups.named` gives captures in the end. Groups are compared by classes of equal extension,
whose ids are called ca and cb where captures (a and b) stand beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import size
from ..storage import saved
from .captures import Groups

#: Pairs within groups are counted directly as long as a capture meets no more others than this in its groups, on the average.
DIRECT_LOAD = 64
#: A value with more captures is dealt out in blocks of about so many, so that no task compares all of them.
BLOCK = 2000
#: In so many of its smallest groups a capture's references are sought before all its groups are looked through.
PROBES = 3

DEP, REF = ("dc", "d1", "d2"), ("rc", "r1", "r2")


def load(sizes: DataFrame) -> tuple[int, float]:
    """The largest group, and how many captures a capture meets in a group on the average."""
    n = F.col("size").cast("double")
    row = sizes.agg(F.max("size").alias("largest"), (F.sum(n * n) / F.sum(n)).alias("load")).first()
    return row.largest or 0, row.load or 0.0


def meetings(members: DataFrame, sizes: DataFrame, largest: int) -> DataFrame:
    """(a, a_support, b, b_support) for each value of which `members` (value, id, support) has a and b.

    A value with k blocks makes k x k cells, the blocks on either side; each pair of captures meets in one of them.
    """
    left, right = (members.select("value", F.col("id").alias(x), F.col("support").alias(f"{x}_support")) for x in "ab")
    if largest <= BLOCK:
        return left.join(right, "value")
    hot = saved(sizes.where(F.col("size") > BLOCK).select("value", F.ceil(F.col("size") / BLOCK).cast("int").alias("k")), "hot")

    def dealt(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        rows = rows.join(hot, "value", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        return rows.select("*", F.pmod(F.xxhash64(name), F.col("k")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias(other)).drop("k")

    return dealt(left, "a", "row", "column").join(dealt(right, "b", "column", "row"), ["value", "row", "column"])


def is_in_every_group(pairs: DataFrame, groups: Groups) -> DataFrame:
    """The pairs (a, b, support) of classes of which b is in every group of a: the overlap equals the support of a."""
    members = groups.members
    met = pairs.join(members.select(F.col("id").alias("a"), "value"), "a").join(members.select(F.col("id").alias("b"), "value"), ["b", "value"], "left_semi")
    return met.groupBy("a", "b", "support").count().where("count = support").select("a", "b", "support")


def class_dependencies(groups: Groups, direct: bool | None = None) -> DataFrame:
    """(a, b, support) of different classes: every value of a is one of b, which therefore has more values.

    Directly, pairs within a group are counted over groups. With large groups (values that very many captures have) the
    references of a class are first sought in its smallest groups, where all of them must be, and then verified.
    """
    members, sizes = groups.members, groups.sizes()
    largest, average = load(sizes)
    if average <= DIRECT_LOAD if direct is None else direct:
        met = meetings(members, sizes, largest).where("a_support < b_support")
        counted = met.groupBy("a", "b", F.col("a_support").alias("support")).count()
        return counted.where("count = support").select("a", "b", "support")
    sized = members.join(sizes.withColumnRenamed("size", "n"), "value")
    least = [F.min(F.struct("n", F.xxhash64(F.lit(k), "value").alias("h"), "value")).getField("value") for k in range(PROBES)]
    probes = sized.groupBy("id", "support").agg(F.array_distinct(F.array(*least)).alias("probes"))
    probes = probes.select(F.col("id").alias("a"), "support", F.size("probes").alias("probes"), F.explode("probes").alias("value"))
    met = probes.join(members.select("value", F.col("id").alias("b"), F.col("support").alias("b_support")), "value").where("support < b_support")
    sought = met.groupBy("a", "b", "support", "probes").count().where("count = probes").select("a", "b", "support")
    return is_in_every_group(saved(sought, "sought"), groups)


def dependencies(groups: Groups, direct: bool | None = None) -> DataFrame:
    """(a, b, DEP, REF, support) of all dependencies that are not trivial."""
    dep, ref = groups.side("d", "cls", "ca", F.col("id").alias("a"), "first", "second"), groups.side("r", "cls", "cb", F.col("id").alias("b"))
    apart = class_dependencies(groups, direct).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "support").join(dep, "ca").join(ref, "cb")
    alike = groups.side("d", "cls", "ca", F.col("id").alias("a"), "first", "second", "support").join(ref, F.col("ca") == F.col("cb")).where("a <> b")
    return apart.unionByName(alike).where("not (b <=> first) and not (b <=> second)").select("a", "b", *DEP, *REF, "support")


def shape(cinds: DataFrame, dep: int, ref: int) -> DataFrame:
    return cinds.where((size(F.col("dc")) == dep) & (size(F.col("rc")) == ref))


def minimal(cinds: DataFrame, groups: Groups) -> DataFrame:
    """Without dependencies (a, b) that follow directly from another one: from one with a weaker dependent or a stronger reference."""
    known, parts = cinds.select("a", "b"), groups.parts()
    weaker = known.join(parts.withColumnRenamed("id", "a"), "a").join(known.withColumnRenamed("a", "part"), ["part", "b"], "left_semi").select("a", "b")
    stronger = known.join(parts.withColumnRenamed("id", "b"), "b").select("a", F.col("part").alias("b"))
    return cinds.join(weaker.unionByName(stronger), ["a", "b"], "left_anti")


def without_rule_implied(cinds: DataFrame, groups: Groups) -> DataFrame:
    """Without the unary pairs x[a] < x[b] of a rule a -> b; `groups` use rules."""
    one = groups.frequent.where("first is null").select("id", F.col("a").alias("uid"), F.col("code").bitwiseAND(56).alias("proj"))
    dep = groups.rules.join(one.select(F.col("id").alias("a"), F.col("uid").alias("ante"), "proj"), "ante")
    implied = dep.join(one.select(F.col("id").alias("b"), F.col("uid").alias("cons"), "proj"), ["cons", "proj"])
    return cinds.join(implied.select("a", "b"), ["a", "b"], "left_anti")


def class_overlaps(groups: Groups) -> DataFrame:
    """(a, b, a_support, b_support, overlap) of classes of unary captures that share a value, a < b."""
    unary = groups.members.where("size = 1")
    sizes = unary.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    met = meetings(unary, sizes, load(sizes)[0]).where("a < b")
    return met.groupBy("a", "b", "a_support", "b_support").agg(F.count(F.lit(1)).alias("overlap"))


def unary_overlaps_by_id(groups: Groups, overlaps: DataFrame) -> DataFrame:
    """(a, b, a_support, b_support, overlap) of unary captures that share a value, each pair once; `overlaps`: of classes."""
    one = groups.frequent.where("first is null")
    left, right = (one.select(F.col("cls").alias(f"c{x}"), F.col("id").alias(x)) for x in "ab")
    apart = overlaps.withColumnsRenamed({"a": "ca", "b": "cb"}).join(left, "ca").join(right, "cb")
    alike = one.select(F.col("cls").alias("ca"), F.col("id").alias("a"), F.col("support").alias("a_support"), F.col("support").alias("b_support"), F.col("support").alias("overlap"))
    alike = alike.join(right, F.col("ca") == F.col("cb")).where("a < b")
    picked = ["a", "b", "a_support", "b_support", "overlap"]
    return apart.select(picked).unionByName(alike.select(picked))


def unary_overlaps(groups: Groups) -> DataFrame:
    """(lc, l1, l2, rc, r1, r2, l_support, r_support, overlap) of unary captures that share a value, each pair once, in the order of captures."""
    found = groups.named(unary_overlaps_by_id(groups, class_overlaps(groups)))
    swap = (F.col("dc") > F.col("rc")) | ((F.col("dc") == F.col("rc")) & (F.col("d1") > F.col("r1")))
    sides = [(f"l{x}", f"d{x}", f"r{x}") for x in "c12"] + [("l_support", "a_support", "b_support")]
    picked = [F.when(swap, F.col(r)).otherwise(F.col(d)).alias(n) for n, d, r in sides]
    picked += [F.when(swap, F.col(d)).otherwise(F.col(r)).alias(n.replace("l", "r", 1)) for n, d, r in sides]
    return found.select(*picked, "overlap")


def both_ways(overlaps: DataFrame) -> DataFrame:
    """(a, b, support, overlap) of overlaps in both directions; `support` is that of a."""
    one = overlaps.selectExpr("a", "b", "a_support as support", "overlap")
    return one.unionByName(overlaps.selectExpr("b as a", "a as b", "b_support as support", "overlap"))


def merged(refs: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): the frequent binary captures b of which a has both parts as references in `refs` (a, b)."""
    tagged = refs.join(groups.unary_of().withColumnRenamed("id", "b"), "b")
    low, high = (tagged.select("a", "proj", F.col("b").alias(name), F.col("cond").alias(f"{name}_cond")) for name in ("first", "second"))
    pairs = low.join(high, ["a", "proj"]).where("first_cond < second_cond")
    return pairs.join(groups.binary(), ["first", "second"]).select("a", F.col("id").alias("b"))


def candidates_12(cinds_11: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): merges of two references of a unary dependent, itself included, that are frequent."""
    own = cinds_11.selectExpr("a", "a as b").distinct()
    return merged(cinds_11.select("a", "b").unionByName(own), groups)


def candidates_21(proper: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): frequent merges a of two dependents that overlap a reference properly and often enough.

    The references are those of the part with the fewer ones, if the other part has them as well: work does not grow with the
    square of a reference's dependents.
    """
    deps = proper.where(F.col("overlap") >= groups.min_support).select(F.col("a").alias("part"), "b")
    degrees = deps.groupBy("part").agg(F.count(F.lit(1)).alias("degree"))
    sided = groups.binary()
    for name in ("first", "second"):
        sided = sided.join(degrees.select(F.col("part").alias(name), F.col("degree").alias(f"{name}_degree")), name)
    few = F.col("first_degree") <= F.col("second_degree")
    sided = sided.select(F.col("id").alias("a"), F.when(few, F.col("first")).otherwise(F.col("second")).alias("part"), F.when(few, F.col("second")).otherwise(F.col("first")).alias("other"))
    return sided.join(deps, "part").join(deps.withColumnRenamed("part", "other"), ["other", "b"], "left_semi").select("a", "b")


def inferred_21(cinds_11: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): 2/1 dependencies that follow from a 1/1, as one part of the dependent is included; the other part overlaps the reference then."""
    parts = groups.parts().withColumnRenamed("id", "a")
    found = parts.join(cinds_11.select(F.col("a").alias("part"), "b"), "part").select("a", "b")
    return found.join(parts.withColumnRenamed("part", "b"), ["a", "b"], "left_anti").distinct()


def candidates_22(all_21: DataFrame, cinds_12: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): merges of two unary references of a binary dependent, or of one and a part of the dependent; those that a 1/2 implies are pruned."""
    deps = all_21.select("a", "b")
    own = deps.select("a").distinct().join(groups.parts().withColumnRenamed("id", "a"), "a").select("a", F.col("part").alias("b"))
    made = merged(deps.unionByName(own), groups).where("a <> b")
    parts = groups.parts().withColumnRenamed("id", "a")
    pruned = made.join(parts, "a").join(cinds_12.select(F.col("a").alias("part"), "b"), ["part", "b"], "left_semi").select("a", "b")
    return made.join(pruned, ["a", "b"], "left_anti")


def verified(candidates: DataFrame, groups: Groups, overlaps: DataFrame) -> DataFrame:
    """(a, b, support) of the candidates (a, b) that hold. Of classes of unary captures `overlaps` tells; the others are looked up in all groups."""
    f = groups.frequent
    rep = f.where("id = cls").select(F.col("id").alias("cls"), (size(F.col("code")) == 1).alias("one"))
    known = f.join(rep, "cls")
    rows = candidates
    for x in "ab":
        rows = rows.join(known.select(F.col("id").alias(x), F.col("cls").alias(f"c{x}"), F.col("support").alias(f"{x}_support"), F.col("one").alias(f"{x}_one")), x)
    rows = saved(rows.where("ca = cb or a_support < b_support"), "candidates")
    asked = rows.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("a_support").alias("support"), (F.col("a_one") & F.col("b_one")).alias("one")).distinct()
    held = both_ways(overlaps).where("overlap = support").select("a", "b")
    told = asked.where("one").join(held, ["a", "b"], "left_semi").select("a", "b")
    found = told.unionByName(is_in_every_group(asked.where("not one").drop("one"), groups).select("a", "b"))
    apart = rows.where("ca <> cb").join(found.select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"], "left_semi")
    picked = ["a", "b", F.col("a_support").alias("support")]
    return apart.select(picked).unionByName(rows.where("ca = cb").select(picked))


class Levels:
    """The levels of `groups` as far as they are asked for: class overlaps, 1/1, proper overlaps, 1/2, 2/1."""

    def __init__(self, groups: Groups):
        self.groups = groups
        self.overlaps = saved(class_overlaps(groups), "overlaps")
        self.ways = saved(both_ways(unary_overlaps_by_id(groups, self.overlaps)), "ways")
        self.c11 = saved(self.ways.where("overlap = support").select("a", "b", "support"), "c11")
        self.proper = self.ways.where("overlap < support")

    def verified(self, candidates: DataFrame, name: str) -> DataFrame:
        return saved(verified(candidates, self.groups, self.overlaps), name)

    def upper(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Dependencies 1/2 and 2/1 found, and the candidates 2/2."""
        c12 = self.verified(candidates_12(self.c11, self.groups), "c12")
        c21 = self.verified(candidates_21(self.proper, self.groups), "c21")
        every_21 = c21.select("a", "b").unionByName(inferred_21(self.c11, self.groups)).distinct()
        return c12, c21, candidates_22(every_21, c12, self.groups)

    def minimal(self) -> DataFrame:
        """(a, b, support) of the minimal dependencies."""
        c12, c21, candidates = self.upper()
        c22 = self.verified(candidates, "c22")
        return minimal(saved(self.c11.unionByName(c12).unionByName(c21).unionByName(c22), "found"), self.groups)
