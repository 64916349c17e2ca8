"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from accountlens.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edits(word: str, letters: str) -> set[str]:
    """All words one edit away, of some letters."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def brute(rows: list) -> list:
    total: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    letters = "".join(sorted({c for w in n for c in w}))
    form, near = {}, {}
    for w in n:
        others = [x for x in edits(w, letters) if x in n]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out, key=str)


def found(df) -> list:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made_up(seed: int, n_words: int = 40) -> list:
    rng = random.Random(seed)
    letters = "abcdeéÀ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n_words)]
    base += [rng.choice(sorted(edits(w, letters))) for w in base for _ in range(2)] + ["ab" * 40, "ab" * 40 + "c", "x" * 700, "x" * 701]
    weights = [rng.choice((1, 2, 6, 40)) for _ in base]
    return [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(base, weights, k=200)) + ", 12 ") for i in range(60)]


@pytest.mark.parametrize(("seed", "block"), [(1, 768), (2, 2), (3, 5)])
def test_variants_are_those_of_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = [*made_up(seed), (3, "again"), (None, "abcabc " * 9), (5, None), (6, ""), (7, "12 ! ā一")]
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))))
    assert got == brute(rows)
    assert any(r[1] for r in got)
    assert any(r[2] not in (r[0], r[1]) for r in got) or seed != 1


def test_worn_occurrences():
    words = [f"{a}{b}cdefgh" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = spelling.occurrences(" ".join(words).encode(), b"17", 6)
    worn = [w for w in words if zlib.crc32(f"17:{w}".encode()) % 199 == 0]
    assert worn
    assert sum(got.values()) == len(words)
    assert not any(w in got for w in worn)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    df = queries.op12_spelling(spark, sf_dir)
    assert df.columns == COLUMNS
    assert found(df) == brute(rows)
