"""Scoring: constants, the golden lead, monotonicity, rules, speed of a rescore."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from accountlens.operators import scoring as G

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decay(spark):
    d = lambda s, a: value(spark, G.decay(F.lit(s), F.lit(a)))
    assert d("jobs", 45) == pytest.approx(0.5) and d("news", 240) == pytest.approx(0.25) and d("registry", 900) == 1.0
    assert value(spark, G.age_days(F.lit("2024-03-01").cast("date"), now(), now())) == 0
    assert value(spark, G.age_days(F.lit(None).cast("date"), F.lit("2024-01-30").cast("timestamp"), now())) == 90


def test_combination(spark):
    n = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(G.noisy_or(F.col("v")).alias("x")).first().x
    assert n(0.5, 0.5) == pytest.approx(0.75) and n(1.0, 0.3) == 1.0
    assert value(spark, G.saturate(F.lit(3.0), 3.0)) == pytest.approx(63.2121, abs=1e-3)
    assert value(spark, G.saturate(F.lit(5.03), 3.0)) == pytest.approx(81.3, abs=0.05) and value(spark, G.saturate(F.lit(0.96), 2.0)) == pytest.approx(38.1, abs=0.05)
    assert value(spark, G.priority(F.lit(92.0), F.lit(81.3), F.lit(38.1))) == pytest.approx(69.1, abs=0.1)
    assert value(spark, G.tier(F.lit(64.96), F.lit(False))) == "hot" and value(spark, G.tier(F.lit(90.0), F.lit(True))) == "disqualified"


def lead(spark, rows, fit=86.7):
    s = spark.createDataFrame([(i, 1, 1, *r, dt.datetime(2024, 1, 1)) for i, r in enumerate(rows)], "signal_id long, company_id long, service_id long, question_id long, strength string, confidence double, source_type string, event_date date, status string, detected_at timestamp")
    q = spark.createDataFrame([(1, "a", "positive", "high", True), (2, "b", "positive", "low", True), (3, "c", "negative", "medium", True), (4, "d", "positive", "high", False)], "question_id long, question_key string, polarity string, weight string, is_active boolean")
    c = spark.createDataFrame([(1, fit)], "company_id long, fit double")
    return G.score(c, s, q, now()).first()


def day(n):
    return dt.date(2024, 1, 31) - dt.timedelta(days=n)


def test_monotone(spark):
    base = [(1, "moderate", 0.8, "news", day(20), "active"), (3, "weak", 0.7, "news", day(9), "active")]
    a = lead(spark, base)
    more = lead(spark, [*base, (2, "strong", 0.9, "report", day(3), "active")])
    bad = lead(spark, [*base, (3, "strong", 0.9, "registry", day(3), "active")])
    old = lead(spark, [(1, "moderate", 0.8, "news", day(200), "active"), base[1]])
    none = lead(spark, [*base, (4, "strong", 0.9, "report", day(3), "active"), (1, "strong", 0.4, "news", day(1), "active"), (1, "strong", 0.9, "news", day(1), "superseded")])
    assert more.intent > a.intent and more.priority > a.priority and bad.priority < a.priority and old.intent < a.intent
    assert none == a and lead(spark, base, 0.0).priority == 0 and lead(spark, base, 0.0).tier == "cold"


def test_evidence_cap_and_full_value(spark):
    rows = [(1, "strong", 1.0, "report", day(0), "active")] + [(1, "weak", 0.6, "news", day(5), "active")] * 6
    assert lead(spark, rows).intent == pytest.approx(100 * (1 - 2.718281828 ** (-3 / 5)), abs=0.05)


def test_fit_and_rules(spark):
    c = spark.createDataFrame([(1, "DE", ["it_services"], 100, None, ["x"]), (2, None, [], None, None, []), (3, "FR", ["retail"], 10, 1, [])], "company_id long, country_code string, industry_ids array<string>, employees long, revenue_eur long, tags array<string>")
    icp = {"countries": ["DE"], "employees_min": 50, "nice_to_have": [{"kind": "industry", "values": ["it_services"], "weight": 3.0}, {"kind": "tag", "values": ["x"], "weight": 1.0}]}
    got = {r.company_id: r for r in G.fit(c, icp).collect()}
    assert got[1].fit == 100 and got[2].fit == pytest.approx(20 + 80 * 1.5 / 4) and got[2].data_gaps == ["country", "employees", "industry"]
    assert got[3].fit == 0 and got[3].failed == ["country", "employees"]
    f = lambda op, v, w: value(spark, G.firmographic_rule(F.lit(op), F.lit(v).cast("string"), F.array(*map(F.lit, w))))
    assert f("lt", 5, ["10"]) and not f("gt", 5, ["10"]) and f("in", "DE", ["DE", "FR"]) and f("not_in", "US", ["DE"]) and not f("lt", None, ["10"])
    s = spark.createDataFrame([(1, 1, 80.0), (2, 1, 70.0), (3, 1, 50.0)], "company_id long, service_id long, priority double")
    hits = spark.createDataFrame([(1, 1, "cap", 40.0, "small"), (1, 1, "cap", 30.0, "smaller"), (2, 1, "exclude", None, "no"), (2, 1, "flag", None, "see")], "company_id long, service_id long, action string, cap_value double, name string")
    out = {r.company_id: (r.priority, r.disqualified, r.hits) for r in G.apply_rules(s, hits).collect()}
    assert out == {1: (30.0, False, ["small", "smaller"]), 2: (0.0, True, ["no", "see"]), 3: (50.0, False, None)}


def test_derived_refresh_params_texts(spark):
    c = spark.createDataFrame([(1, "DE", ["banking"], 60, None), (2, "US", ["banking"], 60, None), (3, "FR", ["food_beverage"], 5, 20_000_000)], "company_id long, country_code string, industry_ids array<string>, employees long, revenue_eur long")
    q = spark.createDataFrame([(7, 1, True, "positive", "compliance"), (5, 1, True, "negative", "compliance")], "question_id long, service_id long, is_active boolean, polarity string, category string")
    d = G.derived_signals(c, q, now())
    assert {(r.company_id, r.source_name, r.question_id) for r in d.collect()} == {(1, "nis2", 7), (1, "dora", 7), (3, "nis2", 7)}
    stored = d.withColumn("signal_id", F.concat(F.lit("old"), "company_id")).where("source_name = 'nis2'")
    assert {r.signal_id for r in G.refresh_derived(stored, d).where("source_name = 'nis2'").collect()} == {"old1", "old3"}
    p = {r.k: r for r in G.resolve_params(spark.createDataFrame([(1, '{"tau_intent": 9}'), (2, '{"tau_intent": -1, "tau_risk": 4}'), (3, None)], "k int, params string")).collect()}
    assert p[1].tau_intent == 9 and p[1].valid and p[2].tau_risk == 2.0 and not p[2].valid
    t = spark.createDataFrame([("Acme", ["Hires"], [1, 2, 3, 4], "speed"), ("Beta", [], [], "speed")], "name string, summaries array<string>, signal_ids array<int>, value_proposition string")
    r = {x.name: x for x in G.outreach_text(t).collect()}
    assert "Hires" in r["Acme"].outreach and r["Acme"].cited == [1, 2, 3] and "speed" in r["Beta"].outreach
    g = spark.createDataFrame([("a", {"weak": "1", "moderate": "2", "strong": "3"}), ("b", {"weak": "1"}), ("z", None)], "category string, temperature map<string,string>")
    guide = {x.category: x.guide for x in G.temperature_guide(g, spark.createDataFrame([("b", {"weak": "b"})], "category string, temperature map<string,string>"), {"weak": "g"}).collect()}
    assert guide == {"a": {"weak": "1", "moderate": "2", "strong": "3"}, "b": {"weak": "b"}, "z": {"weak": "g"}}


def test_rescore_keeps_history(spark):
    old = spark.createDataFrame([(1, 1, "cold", True), (2, 1, "hot", True), (1, 1, "warm", False)], "company_id long, service_id long, tier string, is_current boolean")
    fresh = spark.createDataFrame([(1, 1, "hot"), (3, 1, "cold")], "company_id long, service_id long, tier string")
    snapshots, changes = G.rescore(old, fresh)
    assert {(r.company_id, r.tier) for r in snapshots.where("is_current").collect()} == {(1, "hot"), (2, "hot"), (3, "cold")} and snapshots.count() == 5
    assert {(r.company_id, r.tier_before, r.tier) for r in changes.collect()} == {(1, "cold", "hot"), (3, None, "cold")}
