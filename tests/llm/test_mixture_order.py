"""The encoded corpus lies in the order that the mixing stage wrote."""

from __future__ import annotations

import itertools

import corpus_pipeline

from accountlens.llm import mixing
from accountlens.llm.storage import written

ROWS = [(i, f"text {i} " * (i % 4 + 1), "en", "rare" if i % 9 == 0 else "large", 6) for i in range(200)]


def laid_out(rows):
    rows = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    return [r.doc_id for r in rows]


def test_what_is_encoded_follows_the_mixture(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = written(corpus_pipeline.mix_to_weights(spark, docs, sf_dir), "mixed")
    want = [r.doc_id for r in mixing.mix(docs, mixing.tempered_weights(docs, 0.5)).orderBy("slot", "place").collect()]
    out = corpus_pipeline.byte_bpe(spark, mixed, sf_dir).collect()
    assert [r.doc_id for r in out] == laid_out(out) == want != sorted(want)


def test_order_over_many_files(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    many = written(docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id"), "many")
    assert laid_out(corpus_pipeline.byte_bpe(spark, many, sf_dir).collect()) == list(range(200))
    assert len(laid_out(corpus_pipeline.byte_bpe(spark, docs, sf_dir).collect())) == 200
