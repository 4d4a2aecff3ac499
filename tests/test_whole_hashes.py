from subsumo.operators import dictionary
from subsumo.queries import decompressed_cinds


def test_decompressed_cinds_compresses_every_value(spark, monkeypatch):
    seen, compress = [], dictionary.compress
    monkeypatch.setattr(dictionary, "compress", lambda *a, **k: seen.append(compress(*a, **k)) or seen[-1])
    decompressed_cinds(spark, "/root/testdata/sf0.01")
    escaped = seen[0].where("s like '~%' or p like '~%' or o like '~%'").count()
    assert seen[0].count() > 50_000 and escaped == 0
