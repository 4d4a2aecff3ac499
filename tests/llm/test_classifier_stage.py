"""The classifier stage of the pipeline learns from all labelled documents, not from its input."""

import corpus_pipeline
from subsumo.llm import quality


def test_learns_from_documents_that_are_not_its_input(spark, monkeypatch):
    sf, learnt = "/root/testdata/sf0.01", []
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: learnt.append(y) or fit(x, y))
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, good, sf).collect()}
    want = labels.join(docs, "doc_id", "left_semi").where(~quality.held_out(labels.doc_id))
    assert sorted(learnt[0]) == sorted(r.quality for r in want.collect()) and set(learnt[0]) == {0, 1}
    # The stage scores its input with the forest of the query.
    scores = {r.doc_id: r.score for r in quality.query(spark, sf).collect()}
    assert kept == {r.doc_id for r in good.collect() if scores[r.doc_id] >= quality.GOOD}
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi")
    left = corpus_pipeline.quality_classifier(spark, bad, sf).count()
    assert left < bad.count() / 2
