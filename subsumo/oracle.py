"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

from .queries import SUPPORT
from .sources.tables import TRIPLES_SQL


def captures(projection: str) -> str:
    rows = {
        "s": "SELECT s AS value, 10 AS code, p AS v1, '' AS v2 FROM t UNION ALL SELECT s, 12, o, '' FROM t UNION ALL SELECT s, 14, p, o FROM t",
        "p": "SELECT p AS value, 17 AS code, s AS v1, '' AS v2 FROM t UNION ALL SELECT p, 20, o, '' FROM t UNION ALL SELECT p, 21, s, o FROM t",
        "o": "SELECT o AS value, 33 AS code, s AS v1, '' AS v2 FROM t UNION ALL SELECT o, 34, p, '' FROM t UNION ALL SELECT o, 35, s, p FROM t",
    }
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows[c] for c in projection) + ")"


def base(projection: str = "spo", pruned: bool = False) -> str:
    """Common tables: t, unary, rules, raw (captures), sup, grp, met (pairs with overlap), cinds."""
    cut = "WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE (code & 7) = r.ante_type + r.cons_type AND v1 = CASE WHEN r.ante_type < r.cons_type THEN r.ante ELSE r.cons END AND v2 = CASE WHEN r.ante_type < r.cons_type THEN r.cons ELSE r.ante END)" if pruned else ""
    return f"""
WITH t AS (SELECT DISTINCT * FROM ({TRIPLES_SQL})),
unary AS (SELECT type, value, count(*) AS count FROM (SELECT 1 AS type, s AS value FROM t UNION ALL SELECT 2, p FROM t UNION ALL SELECT 4, o FROM t) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
binary_ AS (SELECT type, v1, v2, count(*) AS count FROM (SELECT 3 AS type, s AS v1, p AS v2 FROM t UNION ALL SELECT 5, s, o FROM t UNION ALL SELECT 6, p, o FROM t) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
rules AS (
  SELECT u.type AS ante_type, b.type - u.type AS cons_type, u.value AS ante, CASE WHEN u.type < b.type - u.type THEN v2 ELSE v1 END AS cons, b.count AS support, CAST(1 AS DOUBLE) AS confidence
  FROM binary_ b JOIN unary u ON (b.type & u.type) <> 0 AND u.value = CASE WHEN u.type < b.type - u.type THEN v1 ELSE v2 END AND u.count = b.count),
raw AS (SELECT value, code, v1, v2 FROM ({captures(projection)}) {cut}),
sup AS (SELECT code, v1, v2, count(*) AS support FROM raw GROUP BY ALL HAVING count(*) >= {SUPPORT}),
grp AS (SELECT value, raw.code, raw.v1, raw.v2, support FROM raw JOIN sup ON raw.code = sup.code AND raw.v1 = sup.v1 AND raw.v2 = sup.v2),
met AS (
  SELECT a.code AS dc, a.v1 AS d1, a.v2 AS d2, b.code AS rc, b.v1 AS r1, b.v2 AS r2, a.support AS support, b.support AS r_support, count(*) AS overlap
  FROM grp a JOIN grp b ON a.value = b.value AND NOT (a.code = b.code AND a.v1 = b.v1 AND a.v2 = b.v2) GROUP BY ALL),
cinds AS (
  SELECT dc, d1, d2, rc, r1, r2, support FROM met WHERE overlap = support
    AND NOT (bit_count(dc & 7) = 2 AND r2 = '' AND ((rc = ({FIRST}) AND r1 = d1) OR (rc = ({SECOND}) AND r1 = d2))))
"""


def first(c: str) -> str:
    return f"({c} & 56) | (({c} & 7) & -({c} & 7))"


def second(c: str) -> str:
    return f"({c} & 56) | (({c} & 7) & (({c} & 7) - 1))"


FIRST, SECOND = first("dc"), second("dc")
DEP_SAME = "x.dc = c.dc AND x.d1 = c.d1 AND x.d2 = c.d2"
REF_SAME = "x.rc = c.rc AND x.r1 = c.r1 AND x.r2 = c.r2"


def implied_by(rows: str, dep: bool) -> str:
    """That a row c follows from a row x of another shape."""
    if dep:
        return f"EXISTS (SELECT 1 FROM {rows} x WHERE {REF_SAME} AND x.d2 = '' AND ((x.dc = ({first('c.dc')}) AND x.d1 = c.d1) OR (x.dc = ({second('c.dc')}) AND x.d1 = c.d2)))"
    return f"EXISTS (SELECT 1 FROM {rows} x WHERE {DEP_SAME} AND bit_count(x.rc & 7) = 2 AND ((c.rc = ({first('x.rc')}) AND c.r1 = x.r1) OR (c.rc = ({second('x.rc')}) AND c.r1 = x.r2)))"


# A 2/2 follows from a 1/2 by its dependent; a 2/1 from a 1/1 likewise; an x/1 from an x/2 by its reference.
MINIMAL = f"""SELECT * FROM cinds c WHERE NOT (bit_count(dc & 7) = 2 AND {implied_by('cinds', True)}) AND NOT (bit_count(rc & 7) = 1 AND {implied_by('cinds', False)})"""


def pretty(c: str, v1: str, v2: str) -> str:
    def char(bit: str) -> str:
        return f"(CASE {bit} WHEN 1 THEN 's' WHEN 2 THEN 'p' WHEN 4 THEN 'o' ELSE '' END)"

    low, high = f"(({c} & 7) & -({c} & 7))", f"(({c} & 7) & (({c} & 7) - 1))"
    return f"{char(f'(({c}) >> 3)')} || '[' || {char(low)} || '=' || {v1} || CASE WHEN {high} = 0 THEN '' ELSE ',' || {char(high)} || '=' || {v2} END || ']'"


CINDS = "SELECT dc, d1, d2, rc, r1, r2, support FROM cinds"
C11 = "u AS (SELECT dc, d1, rc, r1, support, overlap FROM met WHERE d2 = '' AND r2 = ''), c11 AS (SELECT * FROM u WHERE overlap = support)"
MERGE_REFS = "(a.rc & 56) = (b.rc & 56) AND (a.rc & 7) < (b.rc & 7)"
MERGE_DEPS = "(a.dc & 56) = (b.dc & 56) AND (a.dc & 7) < (b.dc & 7)"
CANDIDATES_12 = f"""refs AS (SELECT dc, d1, rc, r1 FROM c11 UNION SELECT dc, d1, dc, d1 FROM c11),
k12 AS (SELECT DISTINCT a.dc, a.d1, '' AS d2, CAST(a.rc | b.rc AS INTEGER) AS rc, a.r1, b.r1 AS r2 FROM refs a JOIN refs b ON a.dc = b.dc AND a.d1 = b.d1 AND {MERGE_REFS}
  JOIN sup ON sup.code = (a.rc | b.rc) AND sup.v1 = a.r1 AND sup.v2 = b.r1)"""
CANDIDATES_21 = f"""k21 AS (SELECT DISTINCT CAST(a.dc | b.dc AS INTEGER) AS dc, a.d1, b.d1 AS d2, a.rc, a.r1, '' AS r2 FROM u a JOIN u b ON a.rc = b.rc AND a.r1 = b.r1 AND {MERGE_DEPS}
  AND a.overlap < a.support AND b.overlap < b.support AND a.overlap >= {SUPPORT} AND b.overlap >= {SUPPORT} JOIN sup ON sup.code = (a.dc | b.dc) AND sup.v1 = a.d1 AND sup.v2 = b.d1)"""
# All 2/1 dependencies that are found or inferred are those that hold with a candidate or with one part included.
CANDIDATES_22 = f"""held AS (SELECT c.* FROM cinds c WHERE bit_count(dc & 7) = 2 AND bit_count(rc & 7) = 1),
sub AS (SELECT DISTINCT dc, d1, d2 FROM held),
refs2 AS (SELECT dc, d1, d2, rc, r1 FROM held UNION SELECT dc, d1, d2, {first('dc')}, d1 FROM sub UNION SELECT dc, d1, d2, {second('dc')}, d2 FROM sub),
k22 AS (SELECT DISTINCT a.dc, a.d1, a.d2, CAST(a.rc | b.rc AS INTEGER) AS rc, a.r1, b.r1 AS r2 FROM refs2 a JOIN refs2 b ON a.dc = b.dc AND a.d1 = b.d1 AND a.d2 = b.d2 AND {MERGE_REFS}
  JOIN sup ON sup.code = (a.rc | b.rc) AND sup.v1 = a.r1 AND sup.v2 = b.r1 WHERE NOT (a.dc = (a.rc | b.rc) AND a.d1 = a.r1 AND a.d2 = b.r1)),
c12 AS (SELECT * FROM cinds WHERE bit_count(dc & 7) = 1 AND bit_count(rc & 7) = 2)"""

OBJECT = "CASE WHEN p = 'segment' THEN '\"' || o || '\"@en' ELSE '<http://x/' || o || '>' END"
HASHES = "h AS (SELECT left(md5(value), 4) AS hash, min(value) AS value, count(*) AS n FROM (SELECT s AS value FROM t UNION SELECT p FROM t UNION SELECT o FROM t) GROUP BY 1)"


def short(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'n%' THEN 'dbpc:' ELSE 'dbpr:' END || {c} AS {c}"


def oracle_sql() -> dict[str, str]:
    b = base()
    of_shape = {f"cinds_{d}{r}": f"{b} {CINDS} WHERE bit_count(dc & 7) = {d} AND bit_count(rc & 7) = {r}" for d in (1, 2) for r in (1, 2)}
    minimal = f"{b} {MINIMAL}"
    pruned = "NOT EXISTS (SELECT 1 FROM rules x WHERE d2 = '' AND r2 = '' AND (dc & 56) = (rc & 56) AND (dc & 7) = x.ante_type AND (rc & 7) = x.cons_type AND d1 = x.ante AND r1 = x.cons)"
    sizes = "sizes AS (SELECT value, count(*) AS size FROM raw GROUP BY value)"
    return {
        "triples": TRIPLES_SQL,
        "distinct_triples": f"{b} SELECT * FROM t",
        "unary_conditions": f"{b} SELECT * FROM unary",
        "binary_conditions": f"{b} SELECT * FROM binary_",
        "association_rules": f"{b} SELECT * FROM rules",
        "captures": f"{b} SELECT * FROM raw",
        "capture_support": f"{b} SELECT * FROM sup",
        "capture_groups_hist": f"{b}, {sizes} SELECT size, count(*) AS groups FROM sizes GROUP BY size",
        "group_load": f"{b}, {sizes} SELECT count(*) AS groups, CAST(sum(size * size) AS BIGINT) AS pairs, sum(size * size) / count(*) AS average_pairs, CAST(round(sqrt(sum(size * size) / count(*))) AS BIGINT) AS block FROM sizes",
        "overlaps_11": f"{b} SELECT dc AS lc, d1 AS l1, d2 AS l2, rc, r1, r2, support AS l_support, r_support, overlap FROM met WHERE d2 = '' AND r2 = '' AND (dc < rc OR (dc = rc AND d1 < r1))",
        "proper_overlaps_11": f"{b} SELECT dc, d1, rc, r1, support, overlap FROM met WHERE d2 = '' AND r2 = '' AND overlap < support",
        **of_shape,
        "cinds_all": f"{b} {CINDS}",
        "cinds_seeded": f"{b} {CINDS}",
        "cinds_minimal": minimal,
        "cinds_levelwise": minimal,
        "cinds_ar_pruned": f"{base(pruned=True)} {CINDS} WHERE {pruned}",
        "cinds_proj_s": f"{base('s')} {CINDS}",
        "cinds_proj_so": f"{base('so')} {CINDS}",
        "candidates_12": f"{b}, {C11}, {CANDIDATES_12} SELECT * FROM k12",
        "candidates_21": f"{b}, {C11}, {CANDIDATES_21} SELECT * FROM k21",
        "candidates_22": f"{b}, {CANDIDATES_22} SELECT * FROM k22 c WHERE NOT {implied_by('c12', True)}",
        "cind_shapes": f"{b} SELECT CAST(bit_count(dc & 7) AS INTEGER) AS dep, CAST(bit_count(rc & 7) AS INTEGER) AS ref, count(*) AS cinds, CAST(sum(support) AS BIGINT) AS support, CAST(0 AS BIGINT) AS trivial FROM cinds GROUP BY 1, 2",
        "cinds_pretty": f"{b} SELECT {pretty('dc', 'd1', 'd2')} || ' < ' || {pretty('rc', 'r1', 'r2')} || ' (support=' || support || ')' AS line FROM cinds",
        "ar_pretty": f"{b} SELECT {pretty('ante_type', 'ante', repr(''))} || ' -> ' || {pretty('cons_type', 'cons', repr(''))} || ' (support=' || support || ',confidence=100.00%)' AS line FROM rules",
        "condition_histogram": f"""{b}, counts AS (SELECT type, count(*) AS count FROM (
            SELECT 1 AS type, s AS v1, '' AS v2 FROM t UNION ALL SELECT 2, p, '' FROM t UNION ALL SELECT 4, o, '' FROM t UNION ALL SELECT 3, s, p FROM t UNION ALL SELECT 5, s, o FROM t UNION ALL SELECT 6, p, o FROM t) GROUP BY type, v1, v2)
            SELECT type, count, count(*) AS conditions FROM counts GROUP BY type, count UNION ALL SELECT 0, count, count(*) FROM counts GROUP BY count""",
        "distinct_value_kinds": f"""{b} SELECT count(*) FILTER (WHERE value NOT LIKE '"%') AS urls, count(*) FILTER (WHERE value LIKE '"%') AS literals FROM (
            SELECT '<http://x/' || s || '>' AS value FROM t UNION SELECT '<http://x/' || p || '>' FROM t UNION SELECT {OBJECT} FROM t)""",
        "count_lines": f"{b} SELECT count(*) AS lines FROM t",
        "hash_collisions": f"{b}, {HASHES} SELECT count(*) FILTER (WHERE n = 1) AS free, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS colliding FROM h",
        "hash_dictionary": f"{b}, {HASHES} SELECT '#' || hash AS hash, value FROM h WHERE n = 1",
        "decompressed_cinds": f"{b} {CINDS}",
        "shorten_iris": f"{b} SELECT {short('s')}, {short('o')}, p FROM t",
        "asciify": f"{b} SELECT chr(105) || chr(1) || s AS s, p, o FROM t",
        "parse_ntriples": f"{b} SELECT '<http://x/' || s || '>' AS s, '<http://x/' || p || '>' AS p, {OBJECT} AS o FROM t",
    }
