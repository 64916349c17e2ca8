"""The trained language model on rows that it has not seen."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from accountlens.functions import language as L


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").where("lang is not null and length(trim(text)) >= 40")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return L.train(docs.where(~held)), docs.where(held)


def test_held_out_rows(parts):
    model, rest = parts
    found = L.with_language(rest, model).select("lang", "language").collect()
    assert len(found) > 100
    assert sum(r.lang == r.language for r in found) > 0.98 * len(found)


def test_short_and_mixed_texts(parts):
    model, rest = parts
    whole = [(r.lang, r.text) for r in rest.where("length(text) > 900").limit(200).collect()]
    short = [(lang, text[300:360]) for lang, text in whole]
    found = L.identify([t for _, t in short], model)
    assert sum(f == lang for f, (lang, _) in zip(found, short, strict=True)) > 0.9 * len(short)
    en = next(t for lang, t in whole if lang == "en")
    de = next(t for lang, t in whole if lang == "de")
    assert L.identify([en[:280] + " " + de[:110], de[:280] + " " + en[:110]], model) == ["en", "de"]


def test_what_says_nothing(spark, parts):
    model, _ = parts
    assert L.identify([None, "", "short", "1234 " * 20], model) == [None] * 4
    df = spark.createDataFrame([("der und die das von " * 4, None), (None, None), ("x", "xx")], "text string, language string")
    assert [r.language for r in L.with_language(df, model).collect()] == ["de", None, "xx"]
    none = L.train(spark.createDataFrame([], "text string, lang string"))
    assert L.identify(["anything at all, as long as it has forty letters"], none) == [None]


def test_buckets_stay_within_their_text():
    owner, bucket = L.buckets(["ab", None, "c"])
    assert [(owner == k).sum() for k in range(3)] == [4 + 3 + 2, 2 + 1 + 0, 3 + 2 + 1]
    alone = L.buckets(["c"])[1]
    assert sorted(bucket[owner == 2].tolist()) == sorted(alone.tolist())
