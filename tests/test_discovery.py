"""Golden cases, brute force, metamorphic checks, and the catalogue against SQL."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from subsumo.functions import codes
from subsumo.functions.values import asciify, chunks, shorten
from subsumo.operators import dictionary
from subsumo.operators.conditions import association_rules, binary_conditions, unary_conditions
from subsumo.oracle import oracle_sql
from subsumo.plans.discover import Config, discover
from subsumo.queries import queries
from subsumo.sources import rdf

from .compare import compare, views

SF = "/root/testdata/sf0.001"
SCHEMA = "s string, p string, o string"


def extensions(triples, projection="spo"):
    found = {}
    for t in triples:
        for code in codes.codes_of(projection):
            value = dict(zip("spo", t))
            cond = [value[codes.CHARS[b]] for b in (1, 2, 4) if code & b]
            found.setdefault((code, *cond, *[""] * (2 - len(cond))), set()).add(value[codes.CHARS[code >> 3]])
    return found


def parts(capture):
    code, v1, v2 = capture
    if not v2:
        return []
    bits = [b for b in (1, 2, 4) if code & b]
    return [((code & 56) | bits[0], v1, ""), ((code & 56) | bits[1], v2, "")]


def brute(triples, support, projection="spo"):
    ext = {c: v for c, v in extensions(triples, projection).items() if len(v) >= support}
    return {(*d, *r, len(ext[d])) for d, r in product(ext, ext) if d != r and r not in parts(d) and ext[d] <= ext[r]}


def brute_minimal(cinds):
    pairs = {(c[:3], c[3:6]) for c in cinds}
    stronger = {(d, p) for d, r in pairs for p in parts(r)}
    return {c for c in cinds if not any((p, c[3:6]) in pairs for p in parts(c[:3])) and (c[:3], c[3:6]) not in stronger}


def random_triples(seed, n=28):
    rng = random.Random(seed)
    return [(rng.choice("abcde"), rng.choice("pqa"), rng.choice("abxyz")) for _ in range(n)]


def found(spark, triples, **options):
    return {tuple(r) for r in discover(spark.createDataFrame(triples, SCHEMA), Config(**options)).collect()}


def test_nine_codes():
    assert codes.VALID == (10, 12, 14, 17, 20, 21, 33, 34, 35)
    assert [c for c in range(256) if codes.is_valid_int(c)] == list(codes.VALID)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    triples = random_triples(seed)
    want = brute(triples, 2)
    assert found(spark, triples, support=2) == want
    assert found(spark, triples, support=2, direct=False) == want
    assert found(spark, triples, support=2, mode="minimal") == brute_minimal(want)
    assert found(spark, triples, support=2, mode="levelwise") == brute_minimal(want)


def test_row_order_duplicates_and_projection(spark):
    triples = random_triples(3)
    want = brute(triples, 2, "so")
    assert found(spark, triples[::-1] + triples[:7], support=2, projection="so", distinct=True) == want


def test_binary_captures_with_swapped_values(spark):
    """A binary reference that shares a value with the dependent in the other place is no part of it."""
    triples = [(s, "a", "b") for s in "xyz"] + [(s, "b", "a") for s in "xyz"]
    got = found(spark, triples, support=3, projection="s")
    assert (14, "a", "b", 14, "b", "a", 3) in got and got == brute(triples, 3, "s")


def test_rules_in_all_directions(spark):
    triples = spark.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("b", "q", "x"), ("a", "p", "x")], SCHEMA)
    got = {tuple(r)[:5] for r in association_rules(unary_conditions(triples, 1), binary_conditions(triples, 1)).collect()}
    want = {(1, 2, "a", "p", 3), (2, 1, "p", "a", 3), (1, 2, "b", "q", 1), (2, 1, "q", "b", 1), (1, 4, "b", "x", 1), (2, 4, "q", "x", 1), (4, 1, "y", "a", 1), (4, 2, "y", "p", 1)}
    assert got == want


def test_config_is_checked():
    for bad in ({"support": 0}, {"projection": "x"}, {"projection": ""}, {"mode": "fast"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_reading(spark, tmp_path):
    import gzip

    text = '﻿# comment\n<a> <p> "x \\" y"@en .\n_:b <p> "1"^^<int> .\n\n<c> <p> <d> .\n'
    with gzip.open(tmp_path / "t.nt.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    want = {("<a>", "<p>", '"x \\" y"@en'), ("_:b", "<p>", '"1"^^<int>'), ("<c>", "<p>", "<d>")}
    assert {tuple(r) for r in rdf.read_triples(spark, str(tmp_path / "*.nt.gz")).collect()} == want
    (tmp_path / "q.nq").write_text("<a> <p> <b> <g> .\n<a> <p> <c> .\n")
    assert rdf.read_triples(spark, str(tmp_path / "q.nq")).count() == 2
    (tmp_path / "tabs.nt").write_text("<a>\t<p>\t<b> .\n")
    assert rdf.read_triples(spark, str(tmp_path / "tabs.nt"), tabs=True).count() == 1
    (tmp_path / "bad.nt").write_text("<a> <p> .\n")
    with pytest.raises(Exception, match="not a statement"):
        rdf.read_triples(spark, str(tmp_path / "bad.nt")).collect()
    with pytest.raises(ValueError):
        rdf.checked("/x/*/y")
    with pytest.raises(ValueError):
        rdf.checked([])


def test_prefixes(spark, tmp_path):
    (tmp_path / "p").write_text("@prefix r: <http://r/> .\n@prefix c: <http://r/C:> .\n@prefix <http://base/> .\n# no\n")
    prefixes = rdf.read_prefixes(spark, str(tmp_path / "p"))
    triples = spark.createDataFrame([("<http://r/a>", "<http://r/C:b>", '"http://r/a"'), ("<http://base/x>", "<http://r/>", "<urn:z>")], SCHEMA)
    got = {tuple(r) for r in shorten(triples, prefixes).collect()}
    assert got == {("r:a", "c:b", '"http://r/a"'), (":x", "r:", "<urn:z>")}
    with pytest.raises(ValueError):
        shorten(triples, prefixes.unionByName(prefixes))


def test_many_prefixes(spark):
    prefixes = spark.range(3000).selectExpr("concat('p', id) AS prefix", "concat('http://h', id, '/') AS url").unionByName(spark.createDataFrame([("h", "http://")], "prefix string, url string"))
    triples = spark.createDataFrame([("<http://h2999/a>", "<http://h3000/b>", None), ("<http://h1/>", "<ftp://h1/>", "http://h1/")], SCHEMA).selectExpr("o", "s", "p", "1 AS extra")
    got = shorten(triples, prefixes)
    assert got.columns == ["o", "s", "p", "extra"]
    assert {tuple(r) for r in got.collect()} == {(None, "p2999:a", "h:h3000/b", 1), ("http://h1/", "p1:", "<ftp://h1/>", 1)}
    assert shorten(triples, prefixes.limit(0)).collect() == triples.collect()


def test_charsets_and_patterns(spark, tmp_path):
    rows = [("<a>", "<b>", '"Zoë"'), ("<c>", "<d>", '"né"')]
    text = "# none\r\n" + "".join(" ".join(r) + " .\r\n" for r in rows)
    for charset in ("UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"):
        folder = tmp_path / charset
        folder.mkdir()
        (folder / "x.nt").write_bytes(text.encode(charset) if charset == "ISO-8859-1" else ("\ufeff" + text).encode(charset))
        (folder / "y.txt").write_text("no statement")
        got = rdf.read_triples(spark, str(folder), pattern="*.nt", charset=charset)
        assert sorted(map(tuple, got.collect())) == rows, charset


def test_asciify(spark):
    assert chunks("abc") == "abc" and chunks("aéb") == "ai\x01b" and chunks("€") == "\x2c\x41"
    assert len(chunks("\U0001f389")) == 6
    df = spark.createDataFrame([("abc",), ("aéb",), (None,)], "v string").select(asciify(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == ["abc", "ai\x01b", None]


def test_dictionary_round_trip(spark):
    triples = spark.createDataFrame([(f"s{i}", "p", f"o{i % 7}") for i in range(60)], SCHEMA)
    for length in (None, 2):
        groups = dictionary.hash_groups(dictionary.distinct_values(triples), length=length).cache()
        short = dictionary.compress(triples, ["s", "p", "o"], groups, length=length)
        assert {tuple(r) for r in dictionary.decompress(short, ["s", "p", "o"], dictionary.dictionary(groups)).collect()} == {tuple(r) for r in triples.collect()}
    with pytest.raises(Exception, match="no dictionary entry"):
        dictionary.decompress(short.limit(60), ["s"], dictionary.dictionary(groups).limit(0)).collect()


def test_text_sink(spark, tmp_path):
    cinds = spark.createDataFrame([(14, "a", "b", 10, "c", "", 3)], "dc int, d1 string, d2 string, rc int, r1 string, r2 string, support long")
    rdf.write_text(cinds.select(rdf.cind_text().alias("line")), f"file:{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["s[p=a,o=b] < s[p=c] (support=3)"]


@pytest.mark.parametrize("name", ["association_rules", "overlaps_11", "cinds_all", "cind_shapes", "cinds_minimal", "cinds_levelwise", "cinds_ar_pruned", "candidates_22", "decompressed_cinds", "condition_histogram"])
def test_queries_equal_sql(spark, name):
    same, got, want = compare(spark, views(SF), SF, queries()[name], oracle_sql()[name])
    assert same and got == want > 0


def test_command_line(spark, tmp_path, capsys):
    from subsumo.__main__ import main

    lines = [f"<s{i}> <p{i % 2}> <o{i % 2}> ." for i in range(12)] + ["# note"]
    (tmp_path / "t.nt").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "t.nt")
    main(["find", path, "--support", "3", "--clean-implied", "--traversal-strategy", "0", "--output", f"file:{tmp_path}/out", "--ar-output", f"file:{tmp_path}/rules", "--counters"], spark)
    assert "s[p=<p0>] < s[p=<p0>,o=<o0>] (support=6)" in {r.value for r in spark.read.text(f"{tmp_path}/out").collect()}
    assert "[p=<p0>] -> [o=<o0>] (support=6,confidence=100.00%)" in {r.value for r in spark.read.text(f"{tmp_path}/rules").collect()}
    main(["count-triples", path], spark)
    main(["count-values", path], spark)
    main(["check-hashes", path], spark)
    main(["count-conditions", path], spark)
    main(["find", path, "--only-read"], spark)
    main(["find", path, "--hash-dictionary", "--support", "3", "--collect-result"], spark)
    out = capsys.readouterr().out.splitlines()
    assert {"12", "16;0", "0;6;6"} <= set(out) and any("(support=6)" in x for x in out)


def test_physical_options_are_accepted():
    from subsumo.__main__ import PHYSICAL_NUMBERS, PHYSICAL_SWITCHES, parser

    args = parser().parse_args(["find", "x.nt", *PHYSICAL_SWITCHES, *(y for x in PHYSICAL_NUMBERS for y in (x, "2"))])
    assert args.use_fis and args.support == 10 and args.inputs == ["x.nt"]


def test_a_hot_value_is_dealt_out_in_blocks(spark, monkeypatch):
    """One value in every capture: blocks of it give the same dependencies."""
    from subsumo.operators import pairs

    rng = random.Random(8)
    triples = [("hot", p, o) for p in "pqr" for o in "abcdef"] + [(rng.choice("uvwx"), rng.choice("pqr"), rng.choice("abcdef")) for _ in range(60)]
    want = brute(triples, 2)
    monkeypatch.setattr(pairs, "BLOCK", 3)
    assert found(spark, triples, support=2, direct=True) == want
    assert found(spark, triples, support=2, mode="levelwise") == brute_minimal(want)


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()
