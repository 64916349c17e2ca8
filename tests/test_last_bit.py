"""Clusters of the same value, whose order the last bit of a figure would decide, and scores of quotes told anew, against the SQL."""

from __future__ import annotations

import datetime
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from accountlens import registry
from accountlens.operators import scoring as G
from accountlens.operators import verify as V
from accountlens.plans.demo import VIEWS, view


def test_decay_is_the_power_of_c(spark):
    """The JVM's own power differs in the last bit for some of these."""
    sources = G.Profile().half_life_days
    rows = spark.range(0, G.DAYS + 50, 7).select(F.col("id").cast("int").alias("age"), F.explode(F.array(*map(F.lit, [*sources, "registry"]))).alias("source_type"))
    for r in rows.select("*", G.decay(F.col("source_type"), F.col("age")).alias("d")).collect():
        want = 0.5 ** (r.age / sources[r.source_type]) if r.source_type in sources else 1.0
        assert r.d == want if r.age < G.DAYS else abs(r.d / want - 1) < 1e-12


def test_confidence_of_the_view_is_that_of_the_sql(spark, sf_dir):
    want = dict(duckdb.sql(f"select signal_id, confidence from ({VIEWS['signal'].replace('from events', f"from '{sf_dir}/events.parquet'")})").fetchall())
    assert {r.signal_id: float(r.confidence) for r in view(spark, sf_dir, "signal").select("signal_id", "confidence").collect()} == want


def test_the_same_sources_have_the_same_confidence(spark):
    rng = random.Random(1)
    rows = [(1, c, f"s{rng.random()}", x) for c in range(300) for x in (0.4 + 0.11, 0.4 + 0.25, 0.4 + 0.43)]
    found = V.cluster_confidence(spark.createDataFrame(rows, "k int, cluster int, source_key string, confidence double"), ["k"]).collect()
    assert len(found) == 300 and {r.sources for r in found} == {3}
    assert len({r.confidence for r in found}) == 1


def compare(spark, sf_dir, tmp_path, name: str, rows: list[tuple]) -> None:
    tables = ("customer", "nation", "lineitem", "documents", "supplier")
    for t in tables:
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in (*tables, "events"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'events' else ''}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert want and plain(map(tuple, df.collect())) == plain(want)


@pytest.mark.parametrize("name", ["g22_why_now", "g23_score_rows"])
def test_lead_of_clusters_of_the_same_value(spark, sf_dir, tmp_path, name):
    """Two clusters of strong leads of one day, each with many weak sources, so that both have the highest confidence."""
    rows = []
    for company, leads in ((29, (4576817, 5976817)), (86, (4777647, 1977647)), (103, (179812, 879812)), (127, (5078092, 5778092))):
        for lead in leads:
            day = datetime.datetime(2024, 1, 24, 1)
            rows += [(lead + 2954 * k, day, company, "view", 10.0 if k else 90.0, "") for k in range(16) if k == 0 or (lead + 2954 * k) % 6]
    compare(spark, sf_dir, tmp_path, name, rows)


@pytest.mark.parametrize("name", ["g07_question_points", "g08_intent_risk", "g23_score", "g27_ranking", "l04_leads", "l13_best_service", "l14_lead_card"])
def test_quotes_told_anew_in_every_score(spark, sf_dir, tmp_path, name):
    """Quotes of one company, question and document, seventeen days apart: two events each."""
    rows = []
    for company in range(60):
        first = 488173 + company
        rows += [(first, datetime.datetime(2024, 1, 27), company, "view", 40.0 + company, ""), (first + 6 * 590800, datetime.datetime(2024, 1, 10), company, "view", 50.0, "")]
    compare(spark, sf_dir, tmp_path, name, rows)
