"""The one-pass page parser against the column expressions that it stands for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from accountlens.functions import text as T
from accountlens.operators import dedup as D
from accountlens.operators import retrieval as R
from accountlens.sources import web as W
from accountlens.sources.pages import clean_lines, find_board, parsed, read_page


def test_text_is_that_of_the_expressions_on_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("company_id", F.col("page_id"))
    body = T.clean_text(T.html_text(F.regexp_replace("html", r"(?is)^.*?<body[^>]*>|<title[^>]*>.*?</title>", "")), 10**9)
    title = F.nullif(T.unescape(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    want = {r.page_id: (r.title, r.body) for r in pages.select("page_id", title.alias("title"), body.alias("body")).collect()}
    got = {r.company_id: (r.title, r.body) for r in parsed(pages).collect()}
    assert got == want


def test_links_wherever_they_stand():
    page = read_page('<body><nav><a class=x href="/a">A &amp; <b>b</b></a></nav><!-- <a href="/no">no</a> --><script>"<a href=\'/no\'>no</a>"; {"datePublished": "2024-01-02"}</script><p>One<a href="#top">top</a><a href=\'c?d=1#e\'> C <br> D</a>two</p><form>f</form></body>')
    assert page.links == [("/a", "A & b"), ("c?d=1", "C D")]
    assert page.date == "2024-01-02"
    assert page.body == "Onetop C\nDtwo"


def test_first_date_and_title():
    page = read_page('<title>a</title><title>b</title><meta property="article:published_time" content="2023-05-06"><script>"datePublished":"2020-01-01"</script>')
    assert (page.title, page.date) == ("a", "2023-05-06")
    assert read_page("") == (None, None, "", [])
    assert read_page("<nav>open").body == "open"


def test_clean_lines():
    assert clean_lines("A  b\r\n\na B\nAccept cookies\n　c\x85C") == "A b\nc"


def test_boards_have_host_and_site():
    assert find_board("x https://boards.greenhouse.io/embed/job_board?for=acme y") == {"ats": "greenhouse", "token": "acme", "host": None, "site": None}
    assert find_board("https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Ext/jobs") == {"ats": "workday", "token": "acme", "host": "acme.wd3.myworkdayjobs.com", "site": "Ext"}
    assert find_board("https://acme.wd3.myworkdayjobs.com/de-DE/Careers") == {"ats": "workday", "token": "acme", "host": "acme.wd3.myworkdayjobs.com", "site": "de-DE"}
    assert find_board("https://acme.wd3.myworkdayjobs.com/en-us/Careers")["site"] == "Careers"
    assert find_board("https://wd5.myworkdaysite.com/en-us/recruiting/acme/Jobs") == {"ats": "workday", "token": "acme", "host": "wd5.myworkdaysite.com", "site": "Jobs"}
    assert find_board("https://acme.jobs.personio.de")["host"] == "acme.jobs.personio.de"
    assert find_board("https://lever.com") is None


def test_report_links_by_all_words_and_years(spark):
    rows = [("https://a.com/Konzernbericht%202023.pdf", ""), ("https://a.com/x_2099_annual_report.pdf", "2022"), ("https://a.com/r.pdf", "Shareholdings report"), ("https://a.com/old.pdf", "annual report 2019"), ("https://a.com/bad%zz.pdf", "Strategie")]
    found = W.rank_report_links(spark.createDataFrame([(1, *r) for r in rows], "company_id int, url string, label string"), 2024, n=9)
    got = {r.url.rsplit("/")[-1]: (r.points, r.year) for r in found.collect()}
    assert got == {"Konzernbericht%202023.pdf": (5, 2023), "x_2099_annual_report.pdf": (6, 2022), "bad%zz.pdf": (3, None)}


def test_mentions_that_follow_each_other():
    assert R.find_mentions("Orange Orange grows", ["Orange"]) == [(0, 6), (7, 13)]
    assert R.find_mentions("Orange County Orange", ["Orange"]) == [(14, 20)]


def test_dedup_of_long_chains_and_hot_keys(spark):
    rng = random.Random(4)
    rows = [(1, i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(12)] + [(2, i, "same", f"h{i}") for i in range(50)]
    rows += [(3, rng.randrange(1000), f"u{rng.randrange(15)}", None if rng.random() < 0.2 else f"h{rng.randrange(15)}") for _ in range(80)] + [(4, 1, None, None)] * 3 + [(5, 7, "u", "h")] * 2
    want = []
    for g in (1, 2, 3, 5):
        seen = set()
        for r in sorted({x for x in rows if x[0] == g}, key=lambda x: (x[1], x[2], x[3] is not None, x[3])):
            keys = {("u", r[2]), ("h", r[3])} - {("h", None)}
            if not keys & seen:
                want.append(r)
                seen |= keys
    want += [(4, 1, None, None)] * 3
    df = spark.createDataFrame(rows, "company_id long, ord long, canonical_url string, content_hash string").withColumn("g", F.lit("clash"))
    assert sorted((tuple(r)[:4] for r in D.collection_dedup(df).collect()), key=str) == sorted(want, key=str)
