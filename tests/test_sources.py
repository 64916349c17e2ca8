"""Scores of signals that say the same weeks apart, against the SQL of their queries."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from accountlens import registry

#: Ids that the view gives one company, service, question, quote and document.
FIRST, STEP = 488173, 590800


@pytest.mark.parametrize("name", ["g06_question_strength", "g23_score_rows"])
def test_a_quote_told_anew_is_a_second_event(spark, sf_dir, tmp_path, name):
    for t in ("customer", "nation", "lineitem"):
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = [(FIRST, datetime.datetime(2024, 1, 27), 8, "view", 50.0, ""), (FIRST + 6 * STEP, datetime.datetime(2024, 1, 10), 8, "view", 50.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("customer", "nation", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'events' else ''}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted([tuple(round(float(v), 5) if not isinstance(v, (str, bool, type(None))) else v for v in r) for r in rows], key=repr)
    assert plain(map(tuple, df.collect())) == plain(want)
    if name == "g06_question_strength":
        assert df.first().n_evidence == 2
