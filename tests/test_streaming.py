"""Streams give the batch operators' rows on the same events."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from accountlens.operators import events as E
from accountlens.plans.demo import view
from accountlens.streaming import events as X
from accountlens.streaming import stateful as K


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def files(spark, df, path, n=3, order="detected_at"):
    """The rows in n files, by time."""
    rows = df.withColumn("_t", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        rows.where(F.col("_t") == i).drop("_t").coalesce(1).write.mode("append").parquet(str(path))
    return X.read_events(spark, str(path), df.schema, 1)


def signals(spark, sf_dir):
    return view(spark, sf_dir, "signal").withColumn("detected_at", F.col("detected_at").cast("timestamp")).where("signal_id < 600")


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, K.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_new_signals_are_those_of_the_batch(spark, tmp_path, rocksdb):
    """Late rows that are earlier than those before them, equal times, rejected first rows, and what was seen before."""
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(3), 0, rng.randrange(2), f"Quote {rng.randrange(9)} ", start + dt.timedelta(hours=rng.randrange(60)), rng.choice(["active", "active", "rejected_by_user"])) for i in range(300)]
    schema = "signal_id long, company_id long, service_id long, question_id long, quote string, detected_at timestamp, status string"
    end = [(10_000, 99, 0, 0, "end", dt.datetime(2025, 1, 1), "active")]  # moves the watermark past all others
    s, seen = spark.createDataFrame(rows, schema), spark.createDataFrame([(-1, 1, 0, 1, "quote 3", start, "rejected_by_user")], schema)
    folder = tmp_path / "exact"
    for part in (rows[:100], rows[100:200], rows[200:], end, [(10_001, *end[0][1:])]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in the order of their times
    got = run(K.new_signals(X.read_events(spark, str(folder), s.schema, 1), seen, "10 days"), "exact")
    want = E.new_signals(s, seen)
    assert sorted(tuple(r) for r in got if r.company_id != 99) == sorted(tuple(r) for r in want.select(*s.columns).collect())
    assert len(got) > 10


def test_once_per_window(spark, tmp_path, rocksdb):
    rng, start = random.Random(7), dt.datetime(2024, 1, 10)
    rows = [(i, rng.randrange(2), rng.randrange(2), start + dt.timedelta(hours=i)) for i in range(80)]
    schema = "notification_id long, rule_id long, company_id long, notified_at timestamp"
    before = [(-1, 0, 0, start - dt.timedelta(hours=3))]
    stream = files(spark, spark.createDataFrame(rows, schema), tmp_path / "once", order="notified_at")
    got = run(K.once_per_window(stream, spark.createDataFrame(before, schema), 24 * 3600, "30 days"), "once")
    last, want = {(0, 0): before[0][3]}, []
    for i, r, c, at in rows:
        if (r, c) not in last or at - last[r, c] >= dt.timedelta(hours=24):
            want.append(i)
            last[r, c] = at
    assert sorted(r.notification_id for r in got) == want


def test_tail_ends_with_the_run(spark, tmp_path, rocksdb):
    rows = [(i, i % 3, "run" if i in (20, 31) else "company", "succeeded" if i in (20, 31) else "done") for i in range(60)]
    rows += rows[:10]
    stream = files(spark, spark.createDataFrame(rows, "id long, run_id long, stage string, status string"), tmp_path / "ends", order="id")
    got = run(K.run_tail(stream, 4), "ends")
    want = [i for i in range(5, 60) if not (i % 3 == 2 and i > 20) and not (i % 3 == 1 and i > 31)]
    assert sorted(r.id for r in got) == want


def test_tier_changes(spark, tmp_path):
    rows = [(i, i % 3, 0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), ["hot", "warm", "warm", "cold"][i // 3 % 4]) for i in range(36)]
    s = spark.createDataFrame(rows, "score_id long, company_id long, service_id long, computed_at timestamp, tier string")
    got = {(r.score_id, r.tier_before, r.tier) for r in run(X.tier_changes(files(spark, s, tmp_path / "b", order="computed_at")), "tiers")}
    assert got == {(r.score_id, r.tier_before, r.tier) for r in E.tier_changes(s).collect()}


def test_rule_matches(spark, sf_dir, tmp_path):
    s, rules = signals(spark, sf_dir).where("status = 'active'"), view(spark, sf_dir, "alert_rule")
    got = {(r.signal_id, r.rule_id) for r in run(X.rule_matches(files(spark, s, tmp_path / "c"), rules), "drafts")}
    assert got == {(r.signal_id, r.rule_id) for r in E.matches(s, rules).collect()} and got


def test_jobs_windows(spark, sf_dir, tmp_path):
    posts = signals(spark, sf_dir).where("source_type = 'jobs'").select("company_id", F.col("detected_at").alias("posted_at"))
    end = spark.createDataFrame([(-1, dt.datetime(2025, 1, 1))], "company_id long, posted_at timestamp")  # moves the watermark past all windows
    stream = files(spark, posts.unionByName(end), tmp_path / "d", order="posted_at")
    got = {(r.company_id, r.until, r.n) for r in run(X.jobs_windows(stream, 24, 2, delay="60 days"), "windows") if r.company_id >= 0}
    want = {(r.company_id, r.until, r.n) for r in E.jobs_windows(posts, 24).where("n >= 2").collect()}
    assert got == want and got


def test_digest_slots(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i)) for i in range(16)] + [(99, 9, dt.datetime(2024, 2, 1))]
    s = spark.createDataFrame(rows, "notification_id long, user_id long, created_at timestamp")
    got = [r for r in run(X.digest_slots(files(spark, s, tmp_path / "e", order="created_at")), "slots") if r.user_id < 9]
    assert sum(r.n for r in got) == 16 and all(r.n == len(r["items"]) == 2 for r in got)


def test_run_tail(spark, sf_dir, tmp_path):
    r = view(spark, sf_dir, "run_event").select("id", "run_id", F.lit(dt.datetime(2024, 1, 1)).alias("created_at"))
    got = run(X.run_tail(files(spark, r.unionByName(r), tmp_path / "f", order="id"), 500), "tail")
    assert sorted(x.id for x in got) == sorted(x.id for x in E.replay(r, 500).collect())


def test_fan_out(spark, tmp_path):
    """A consumer that fails three batches is tried in each, one that always fails is given up; the ledger's folders stay few."""
    ledger, seen, tries = tmp_path / "ledger", {"a": [], "b": []}, []

    def broken(df):
        tries.append(sorted(r.event_id for r in df.collect()))
        if len(tries) <= 3:
            raise OSError("down")
        seen["b"] += tries[-1]

    def dead(df):
        df.count()
        raise OSError("gone")

    f = X.fan_out({"a": lambda df: seen["a"].extend(r.event_id for r in df.collect()), "b": broken, "c": dead}, str(ledger))
    for k in range(8):
        f(spark.createDataFrame([(f"e{k}", k)], "event_id string, n int"), k)
        assert len(list(ledger.glob("v=*"))) <= 2
        assert len(list(ledger.glob("v=*/*.parquet"))) <= 2
    assert tries[:4] == [[f"e{i}" for i in range(k + 1)] for k in range(4)]
    assert tries[4:] == [["e4"], ["e5"], ["e6"], ["e7"]]
    assert sorted(seen["a"]) == sorted(seen["b"]) == [f"e{k}" for k in range(8)]
    rows = {(r.event_id, r.attempts, r.given_up) for r in spark.read.parquet(f"{ledger}/v=7").where("consumer = 'c'").collect()}
    assert rows == {(f"e{k}", min(5, 8 - k), k <= 3) for k in range(8)}
    f(spark.createDataFrame([("e7", 7)], "event_id string, n int"), 7)  # the batch is run again: from the state before it
    assert {(r.event_id, r.attempts, r.given_up) for r in spark.read.parquet(f"{ledger}/v=7").where("consumer = 'c'").collect()} == rows


def test_late_rows(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "id int, created_at timestamp")
    on_time, late = X.late_rows(df, "created_at", F.lit("2024-01-05").cast("timestamp"))
    assert [r.id for r in on_time.collect()] == [2] and [r.id for r in late.collect()] == [1]
