"""Snapshots in buckets against whole runs."""

from __future__ import annotations

import random

from accountlens.operators import dedup as D
from accountlens.operators.snapshots import Snapshots, rescored

SCHEMA = "company_id long, service_id long, version long, fingerprint string"
KEYS = ["company_id", "service_id"]


def test_changes_equal_whole_runs_and_touch_few_buckets(spark, tmp_path):
    rng = random.Random(1)
    store = Snapshots(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    assert store.read().collect() == []
    every = []
    for n in range(6):
        rows = {(c, s): (c, s, n, f"f{rng.randrange(9)}") for c, s in ((rng.randrange(60), rng.randrange(2)) for _ in range(40 if n == 0 else 4))}
        every += rows.values()
        touched = store.put(spark.createDataFrame(list(rows.values()), SCHEMA), KEYS, "version")
        assert len(touched) <= len({c for c, _ in rows})
        want = D.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame(every, SCHEMA), KEYS, "version")
        assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))


def test_one_company_rewrites_one_bucket(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), SCHEMA, buckets=16)
    store.put(spark.range(200).selectExpr("id as company_id", "id % 2 as service_id", "1L as version", "'x' as fingerprint"), KEYS, "version")
    before = store.manifest()[1]
    touched = store.put(spark.createDataFrame([(7, 0, 2, "y"), (7, 1, 2, "z")], SCHEMA), KEYS, "version")
    after = store.manifest()[1]
    assert len(touched) == 1
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert len(list((tmp_path / "s" / "data" / "v=2").glob("_b=*"))) == 1
    assert store.read().count() == 201


def test_what_is_to_be_scored_anew(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.put(spark.createDataFrame([(1, 0, 1, "a"), (2, 0, 1, "b")], SCHEMA), KEYS, "version")
    fresh = spark.createDataFrame([(1, 0, "a"), (2, 0, "c"), (3, 0, "d")], "company_id long, service_id long, fingerprint string")
    assert sorted(map(tuple, rescored(fresh, store, KEYS).collect())) == [(2, 0), (3, 0)]


def test_old_versions_go(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), SCHEMA, buckets=1)
    for n in range(1, 18):
        held = store.read()  # a reader of the state before
        store.put(spark.createDataFrame([(1, 0, n, f"f{n}")], SCHEMA), KEYS, "version")
        assert [r.fingerprint for r in held.collect()] == ([f"f{n - 1}"] if n > 1 else [])
    assert [tuple(r) for r in store.read().collect()] == [(1, 0, 17, "f17")]
    assert len(list((tmp_path / "s" / "data").glob("v=*/_b=*"))) <= 2
    assert len(list((tmp_path / "s" / "manifest").glob("*.parquet"))) <= 3
