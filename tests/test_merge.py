"""Merging the rows of a domain without a window over it."""

from __future__ import annotations

from accountlens.operators import accounts as A


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    made = [("a", 2, None, 7), ("a", 1, None, None), ("a", 3, "x", 8), ("a", None, None, 9), ("b", 5, "y", None), (None, 1, "z", 1), (None, 2, "w", 2)]
    return spark.createDataFrame(made, "domain string, row int, label string, employees int")


def test_merge_is_an_aggregate(spark):
    merged = A.merge_duplicates(rows(spark))
    assert "Window" not in plan(merged) and merged.columns == ["domain", "row", "label", "employees"]
    assert {tuple(r) for r in merged.collect()} == {("a", None, "x", 9), ("b", 5, "y", None), (None, 1, "z", 1)}
    first = A.merge_duplicates(rows(spark), "skip")
    assert {tuple(r) for r in first.collect()} == {("a", None, None, 9), ("b", 5, "y", None), (None, 1, "z", 1)}


def test_upsert_of_a_large_domain(spark):
    """What is set in one of very many rows of a domain gets into the company."""
    many = spark.range(60_000).selectExpr("id as row", "concat('d', id % 2) as domain", "if(id >= 59998, concat('l', id), null) as label", "if(id % 30000 = 7, id, null) as employees")
    old = spark.createDataFrame([("d0", None, None), ("d2", "kept", 3)], "domain string, label string, employees long")
    done = A.upsert_companies(old, A.merge_duplicates(many), ["label", "employees"])
    assert "Window" not in plan(done)
    assert {tuple(r) for r in done.collect()} == {("d0", "l59998", None, "updated"), ("d1", "l59999", 7, "created"), ("d2", "kept", 3, "untouched")}
