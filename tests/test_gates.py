"""The tests of characters that spare most texts the tables of letters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from accountlens.functions import letters as L
from accountlens.functions import text as T


def test_a_gate_lets_every_letter_in():
    for one, _, many in (L.casefolds(), L.marked_letters()):
        for letters in (one, "".join(a for a, _ in many if ord(a) >= 0x100)):
            pattern = L.gate(letters)
            low = {c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if set(f"a{c}".lower()) & set(letters)}
            assert low and all(re.fullmatch(pattern, c) for c in low)
            assert not re.search(pattern, "plain words 123") and len(pattern) < 80


def test_texts_fold_as_their_letters_do(spark):
    words = ["ΟΔΟΣ ὈΔΌΣ", "Straße STRASSE ﬁ", "µ ſ ŉ", "plain", "Ärger ñ", "ẞ ΐ ᾳ", "Ꭰꭰ", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.casefold(F.col("w")).alias("c"), T.fold(F.col("w")).alias("f"), T.content_hash(F.concat(F.lit(" 　"), "w", F.lit("\t"))).alias("h"), T.content_hash(F.col("w")).alias("g")).collect()
    assert [r.c for r in rows] == [w.casefold() for w in words]
    assert all(r.h == r.g for r in rows)
    assert [r.f for r in rows[:2]] == ["odos odos", "strasse strasse fi"]
