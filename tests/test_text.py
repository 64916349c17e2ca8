"""Text functions: pinned constants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from accountlens.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/news/?utm_source=x&keep=yes&fbclid=secret#part", "https://example.com/news?keep=yes"),
        ("http://a.b:80/x/", "http://a.b/x"),
        ("https://a.b:8443/", "https://a.b:8443"),
        ("https://a.b/?b=2&a=1&flag", "https://a.b?b=2&a=1&flag="),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, T.canonical_url(F.lit(url).cast("string"))) == want


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.lit("Title\nAccept all cookies\nBody   text\nBody text"))) == "Title\nBody text"
    assert value(spark, T.clean_text(F.lit("a b c"), 3)) == "a b"
    assert value(spark, T.clean_text(F.lit("b\nA\na\nB\n\nc"))) == "b\nA\nc"
    assert value(spark, T.clean_text(F.lit(""))) == ""


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Sun, 20 Sep 2026 10:00:00 +0200", dt.datetime(2026, 9, 20, 8)),
        ("2026-09-20", dt.datetime(2026, 9, 20)),
        ("2026-09-20T10:00:00Z", dt.datetime(2026, 9, 20, 10)),
        ("2026-09-20T10:00:00", dt.datetime(2026, 9, 20, 10)),
        ("Mon, 5 Jan 2026 10:00:00 GMT", dt.datetime(2026, 1, 5, 10)),
        ("not a date", None),
    ],
)
def test_dates(spark, said, want):
    got = value(spark, F.date_format(T.utc_datetime(F.lit(said)), "yyyy-MM-dd HH:mm:ss"))
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize(("said", "want"), [("10001+", 10001), ("1001-5000", 1001), ("$1B to $10B", 10**9), ("€81.8bn", 81_800_000_000), ("1.234,5", 1234.5), ("1,234,567", 1234567), ("12k", 12000), ("none", None)])
def test_amounts(spark, said, want):
    got = value(spark, T.amount(F.lit(said)))
    assert got is None if want is None else float(got) == want


def test_domains_and_names(spark):
    assert value(spark, T.normalize_domain(F.lit(" HTTPS://www.Example.com:443/path?x"))) == "example.com"
    assert value(spark, T.normalize_domain(F.lit("no domain"))) is None
    assert value(spark, T.name_key(F.lit("The Müller & Söhne GmbH & Co. KG"))) == "muller sohne"
    assert value(spark, T.name_variants(F.lit("Acme Holding AG"))) == ["Acme Holding AG", "Acme"]
    assert value(spark, T.search_name(F.lit("ABC"), F.lit(None).cast("string"), F.array(F.lit("abc"), F.lit("Alphabet Corp")))) == "Alphabet Corp"
    assert value(spark, T.own_host(F.lit("jobs.acme.com"), F.lit("acme.com"))) and not value(spark, T.own_host(F.lit("notacme.com"), F.lit("acme.com")))
    assert value(spark, T.fold(F.lit("Straße ÉÀç œuvre"))) == "strasse eac oeuvre"


def test_numbers_and_quotes(spark):
    assert value(spark, T.numbers(F.lit("4,000 and 4000 and 3.5"))) == ["4000", "35"]
    assert value(spark, T.numbers_agree(F.lit("4,000 jobs"), F.lit("4000 jobs in 2024")))
    assert not value(spark, T.numbers_agree(F.lit("4 jobs"), F.lit("5 jobs")))
    assert value(spark, T.normal_quote(F.lit("“A”  –  b…"))) == '"a" - b...'


def test_html_and_gist(spark):
    assert value(spark, T.html_text(F.lit("<p>One &amp; <b>two</b></p><script>x()</script><ul><li>three</li></ul>"))) == "One & two\nthree"
    assert value(spark, T.html_text(F.lit("&lt;p&gt;Hi&lt;/p&gt;"), escaped=True)) == "Hi"
    assert value(spark, T.gist(F.lit("First one. Second."))) == "First one."
    assert value(spark, F.length(T.gist(F.lit("x" * 200)))) == 90
    assert value(spark, F.year(T.report_date(F.lit("D:20230405"), F.lit("")))) == 2023
    assert value(spark, F.year(T.report_date(F.lit("D:20231405"), F.lit("/2021/ar.pdf")))) == 2021


def test_case_folds_letters_of_one_kind(spark):
    assert value(spark, T.casefold(F.lit("STRASSE Straße ΟΔΟΣ"))) == "strasse strasse οδοσ"
    assert value(spark, T.content_hash(F.lit("Straße"))) == value(spark, T.content_hash(F.lit("STRASSE")))
