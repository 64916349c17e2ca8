"""Folding of letters against the standard library."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from accountlens.functions import letters as L
from accountlens.functions import text as T
from accountlens.operators import verify as V


def test_case_folding_is_the_librarys(spark):
    # The JVM's lower case is that of an older Unicode: letters that it does not know yet are left out.
    old = unicodedata.ucd_3_2_0
    cps = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and old.category(chr(c)) != "Cn"]
    rows = spark.createDataFrame([(chr(c),) for c in cps], "c string").select("c", T.casefold(F.col("c")).alias("f")).collect()
    assert [(hex(ord(r.c)), r.f) for r in rows if r.f != r.c.casefold()] == []
    words = ["STRASSE straße", "ΟΔΟΣ", "ﬃ ﬁ", "ŉ ǰ", "", None]
    assert [r.f for r in spark.createDataFrame([(w,) for w in words], "c string").select(T.casefold(F.col("c")).alias("f")).collect()] == [w and w.casefold() for w in words]


def test_folding_to_latin_letters(spark):
    words = {"Müller & Søn": "muller & son", "Straße Łódź": "strasse lodz", "Газпром": "gazprom", "Щука ЮЛА": "shchuka iula", "Ωμέγα Ψ": "omega ps", "ﬁn Œuvre": "fin oeuvre", "Æsir": "aesir", "Ǿ ǻ": "o a"}
    rows = spark.createDataFrame([(w,) for w in words], "c string").select("c", T.fold(F.col("c")).alias("f")).collect()
    assert {r.c: r.f for r in rows} == words
    one, plain, many = L.marked_letters()
    assert len(one) == len(plain)
    assert all(L.plain_letters(a) == b for a, b in [*zip(one, plain, strict=True), *many])


def test_words_in_other_scripts_are_alike():
    assert V.folded_words("Завод в Москве – 4,000 мест") == "zavod v moskve 4 000 mest"
    assert V.folded_words("ΕΛΛΑΣ Ελλάς") == "ellas ellas"
    assert V.folded_words("日本") == ""


def test_quotes_have_one_form(spark):
    words = ["ﬁrst “quote” … １２", "Ｆｕｌｌ width", "  a   b ", "é", None, "ΣΑΣ – x"]
    rows = spark.createDataFrame([(w,) for w in words], "c string").select(T.normal_quote(F.col("c")).alias("f")).collect()
    assert [r.f for r in rows] == ['first "quote" ... 12', "full width", "a b", "é", None, "σασ - x"]
