"""Figures of six digits whose seventh is a five and the last, against the SQL."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from accountlens import registry
from accountlens.plans.scoring_queries import rounded


def test_ties_go_as_in_duckdb(spark):
    """Spark's round goes up at each of these, DuckDB's down at one of ninety."""
    got = spark.range(5, 10_000_000, 70).withColumn("x", F.col("id").cast("double") / 1e7).select("id", rounded(F.col("x")).alias("y"), rounded(-F.col("x")).alias("z")).collect()
    want = duckdb.sql("select x, round(x::double / 1e7, 6), round(-x::double / 1e7, 6) from range(5, 10000000, 70) t(x)").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(y != (x + 5) / 1e7 for x, y, _ in want)


def test_what_is_no_number_stays_so(spark):
    values = [float("inf"), float("-inf"), None, 0.0, 1e300, 12.3]
    assert [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(rounded(F.col("x")).alias("y")).collect()] == values


@pytest.mark.parametrize("name", ["g06_question_strength", "g07_question_points", "l14_lead_card"])
def test_points_of_two_sources(spark, sf_dir, tmp_path, name):
    """A moderate lead of a register at 0.69 or 0.89 and a second source: the points are 0.5070195."""
    rows = []
    for company, pair in enumerate(((29, 124097), (449, 35897), (449, 124517), (869, 36317), (1289, 125357))):
        rows += [(e, datetime.datetime(2024, 1, 20), company, "view", value, "") for e, value in zip(pair, (50.0, 10.0), strict=True)]
    for t in ("customer", "nation", "lineitem"):
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("customer", "nation", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'events' else ''}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert len(want) == 5 and sorted(map(tuple, df.collect())) == sorted(want)
