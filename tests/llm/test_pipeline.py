"""Each stage of the pipeline against what it must keep and change."""

from conftest import words  # noqa: F401

import corpus_pipeline
from docketlens.llm import jaccard, pii, quality


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    cols, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        seen[name] = docs
        if i < 4:
            assert docs.columns == cols
        if i == 0:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.ledger(before).where(quality.passes()).collect()}
        if i == 1:
            groups = {r.doc_id: r.component_id for r in jaccard.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(groups.values()))
        if i == 2:
            assert docs.count() == before.count() and not any(pii.base_spans(r.text) for r in docs.collect())
        if i == 3:
            assert set(r.doc_id for r in docs.collect()) <= set(r.doc_id for r in before.collect())
        if i == 4:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_stages_take_empty_and_odd_documents(spark, odd, empty):
    for docs in (odd, empty):
        d = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "")
            d.count()


def test_stages_take_columns_named_like_their_own(spark, odd):
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_caps fail_bits _words _h _doc spans clean n_email base_sha256 _text _terms _key _k row key target copies taken n node part a b".split()
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(f"own {c}") for c in names})
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and all(r[c] == f"own {c}" for r in kept.collect() for c in names)
