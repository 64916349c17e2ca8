"""All cosines: what is shuffled does not grow with the pairs, and figures are rounded without decimals as with them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from accountlens import registry
from accountlens.operators import impact as I
from accountlens.plans.scoring_queries import rounded, rounded_binary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark, df):
    """(rows that df brings, bytes shuffled for it)."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    return len(df.collect()), written() - before


@pytest.mark.parametrize("n", [100, 200])
def test_a_vector_is_shuffled_once(spark, monkeypatch, n):
    """Twice the vectors in blocks of one size: four times the rows, and a vector still moves once. With blocks dealt to pairs, each moved with every block of the other side."""
    monkeypatch.setattr(I, "SHARD", 10)
    monkeypatch.setattr(I, "PAIRED", 5)
    rng = random.Random(7)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(n)], "chunk_id long, embedding array<float>")
    rows, moved = shuffled(spark, I.cosine_all(v, v.where("chunk_id % 2 = 0").withColumnRenamed("chunk_id", "question_id")))
    assert rows == n * n // 2
    assert moved < 1.5 * n * 500  # 256 bytes of figures in a row of under 400, and half of the rows once more


def test_nothing_is_dealt_after_the_product(spark, sf_dir):
    text = plan(registry.QUERIES["r06_cosine"](spark, sf_dir))
    assert text.count("Exchange ") == 2 and "Exchange " not in text.split("CartesianProduct")[0]
    assert "Broadcast" not in text


def test_binary_rounding_is_that_by_decimals(spark):
    rng = random.Random(11)
    values = [k / 2e6 for k in range(-2001, 2001)] + [rng.uniform(-1, 1) for _ in range(20_000)] + [x / 1e7 for x in range(5, 10_000_000, 7_010)]
    values += [0.49999999999999994e-6, -0.49999999999999994e-6, -0.0, 0.0, -1e-9, 1.0, -1.0, 1e300, float("inf"), float("-inf"), float("nan"), None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x")).alias("a"), rounded_binary(F.col("x")).alias("b")).collect()
    assert [r for r in got if repr(r.a) != repr(r.b)] == []
