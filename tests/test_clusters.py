"""Clusters of signals of one event against the rule on all pairs."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from accountlens.operators import clusters as C
from accountlens.operators import verify as V
from accountlens.operators.components import components

WORDS = "acme opens new plant in berlin with four hundred jobs after strong growth of orders Zürich Straße 4,000 300 the a it said".split()
SCHEMA = "q long, signal_id long, date date, quote string, summary string, document_id string, source_key string"


def made_up(seed: int, n: int, questions: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.choice((2, 4, 7, 12)))) for _ in range(max(3, n // 6))]

    def text():
        if rng.random() < 0.1:
            return rng.choice(("", None, "…"))
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            words += rng.choices(WORDS, k=rng.choice((1, 5)))
        if rng.random() < 0.3:
            rng.shuffle(words)
        out = " ".join(words)
        if rng.random() < 0.3 and len(out) > 4:
            k = rng.randrange(len(out))
            out = out[:k] + out[k + 1 :]
        return out.upper() if rng.random() < 0.1 else out

    day = datetime.date(2024, 1, 1)
    return [(rng.randrange(questions), i, None if rng.random() < 0.1 else day + datetime.timedelta(rng.randrange(200)), text(), text(), str(rng.randrange(8)), rng.choice((None, "a", "b"))) for i in range(n)]


def by_pairs(rows: list[tuple]) -> dict:
    numbers = [{x.replace(".", "").replace(",", "") for x in V._NUMBER.findall(" ".join(t for t in r[3:5] if t is not None))} for r in rows]
    texts = [(V.folded_words(r[3]), V.folded_words(r[4])) for r in rows]

    def alike(x, y):
        return bool(x and y) and (V.token_sort_ratio(x, y) >= 82 or (min(len(x.split()), len(y.split())) >= 5 and V.token_set_ratio(x, y) >= 95))

    def one_event(i, j):
        a, b = rows[i], rows[j]
        if a[0] != b[0]:
            return False
        if a[6] is not None and a[6] == b[6] and a[5] == b[5] and a[3] is not None and a[3] == b[3]:
            return True
        if a[2] and b[2] and abs((a[2] - b[2]).days) > 14:
            return False
        if not (numbers[i] <= numbers[j] or numbers[j] <= numbers[i]):
            return False
        return alike(texts[i][0], texts[j][0]) or alike(texts[i][1], texts[j][1])

    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and one_event(i, j):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {r[1]: rows[root(i)][1] for i, r in enumerate(rows)}


@pytest.mark.parametrize(("seed", "n", "questions", "group", "block"), [(1, 240, 40, 1024, 512), (2, 160, 2, 1024, 512), (3, 200, 2, 20, 512), (4, 220, 3, 10, 7), (5, 120, 1, 0, 3)])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, seed, n, questions, group, block):
    monkeypatch.setattr(C, "GROUP", group)
    monkeypatch.setattr(C, "BLOCK", block)
    rows = made_up(seed, n, questions)
    found = C.event_clusters(spark.createDataFrame(rows, SCHEMA).withColumn("value", F.lit(1.0)), ["q"])
    assert found.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "value", "cluster"]
    got = {r.signal_id: r.cluster for r in found.collect()}
    assert got == by_pairs(rows)
    assert len(set(got.values())) < n


def test_no_link_passes_the_bounds(monkeypatch):
    rows = made_up(7, 300, 1)
    texts = sorted({V.folded_words(r[3]) for r in rows} - {""})
    one = C.shapes(texts)
    for i, x in enumerate(texts):
        for y, ok in zip(texts, C.possible(i, one, one), strict=True):
            assert ok or not C.alike(x, y)


def test_question_of_one_text(spark, monkeypatch):
    """Copies of a text in a large question are a run of days, not pairs."""
    monkeypatch.setattr(C, "GROUP", 100)
    df = spark.range(5000).select(F.lit(1).alias("q"), F.col("id").alias("signal_id"), F.expr("date_add(date '2024-01-01', cast(id % 3 * 40 as int))").alias("date"), F.lit("The same words again").alias("quote"), F.lit(None).cast("string").alias("summary"))
    got = C.event_clusters(df, ["q"]).groupBy("cluster").count().collect()
    assert sorted((r.cluster, r["count"]) for r in got) == [(0, 1667), (1, 1667), (2, 1666)]


def test_no_signals(spark):
    assert C.event_clusters(spark.createDataFrame([], SCHEMA), ["q"]).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(rng.choice((100, 200, 400)))] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(100)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in linked}
    assert len(got) == len(linked)
