"""Dedup, retrieval, verification, corroboration, accounts, sources: against small sequential oracles and hand-made payloads."""

from __future__ import annotations

import json
import random
import unicodedata

from pyspark.sql import functions as F

from accountlens.operators import accounts as A
from accountlens.operators import dedup as D
from accountlens.operators import events as E
from accountlens.operators import leads as L
from accountlens.operators import retrieval as R
from accountlens.operators import verify as V
from accountlens.sources import landing as S
from accountlens.sources import web as W


def test_collection_dedup_is_the_ordered_fold(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, f"u{rng.randrange(40)}" if rng.random() < 0.9 else None, f"h{rng.randrange(40)}") for i in range(150)]
    rows += [(9, 1, "u1", "h1"), (9, 2, "u2", "h1"), (9, 3, "u2", "h3")]
    want = []
    for c in {r[0] for r in rows}:
        urls, hashes = set(), set()
        for r in sorted(x for x in rows if x[0] == c):
            if r[2] not in urls and r[3] not in hashes:
                want.append(r[:2])
                hashes.add(r[3])
                urls |= {r[2]} - {None}
    df = spark.createDataFrame(rows, "company_id long, ord long, canonical_url string, content_hash string")
    assert sorted((r.company_id, r.ord) for r in D.collection_dedup(df).collect()) == sorted(want)
    assert (9, 1) in want and (9, 3) in want and (9, 2) not in want


def test_state_and_batches(spark):
    q = spark.createDataFrame([(1, 1, i, 30) for i in range(8)], "company_id long, service_id long, ord long, tokens long")
    got = {r.ord: r.batch for r in D.extraction_batches(q, 70).collect()}
    assert [got[i] for i in range(8)] == [0, 0, 1, 1, 2, 2, 3, 3]
    plan = D.collect_plan(spark.createDataFrame([(1, ["news"], 30, {"de": ["x"], "en": ["a", "b"]}), (1, ["jobs"], 90, {"en": ["a"]})], "service_id int, source_types array<string>, recency_days int, keywords map<string,array<string>>")).first()
    assert plan.days == 90 and plan.source_types == ["jobs", "news"] and set(plan.topics) == {"a", "b", "x"}
    fp = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "company_id int, service_id int, fingerprint string")
    assert [r.company_id for r in D.changed(fp, fp.where("company_id = 1")).collect()] == [2]


def test_sentences_and_chunks(spark):
    text = 'One is here. "Two!" said she.\nThree?  Four… end'
    rows = R.sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("nth").collect()
    assert [r.text for r in rows] == ["One is here.", '"Two!', "said she.", "Three?", "Four…", "end"]
    assert all(text[r.start : r.start + len(r.text)] == r.text for r in rows)
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randint(1, 9) + (". " if rng.random() < 0.07 else "") for _ in range(rng.choice([5, 130, 900])))) for i in range(12)] + [(99, ""), (98, None)]
    got = R.chunk_documents(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    for i, t in docs:
        mine = sorted((r.ord, r.char_start, r.char_end, r.text) for r in got if r.doc_id == i)
        assert all(t[a:b] == x for _, a, b, x in mine)
        covered = {w for _, a, b, _ in mine for w in range(a, b)}
        assert all(p in covered for p, c in enumerate(t or "") if not c.isspace())
        assert all(len(x.split()) <= 280 for *_, x in mine)


def test_budget_is_the_loop(spark):
    rng = random.Random(8)
    for most, tokens in ((6, 10**6), (40, 900), (5, 700)):
        rows = [(1, q, c, rng.random(), n + 1, "high" if q % 2 else "low", 100) for q in range(4) for n, c in enumerate(rng.sample(range(14), 5))]
        best, guarded = {}, set()
        for _, q, c, rrf, nth, w, _ in rows:
            best[c] = max(best.get(c, 0), rrf)
            if nth <= (2 if w == "high" else 1):
                guarded.add(c)
        kept = set(best)
        for c in sorted(kept - guarded, key=lambda c: (best[c], -c)):
            if len(kept) <= most and 100 * len(kept) <= tokens:
                break
            kept.discard(c)
        df = spark.createDataFrame(rows, "company_id int, question_id int, chunk_id int, rrf double, nth int, weight string, tokens int")
        assert {r.chunk_id for r in R.apply_budget(df, ["company_id"], most, tokens).collect()} == kept


def test_mentions():
    assert R.find_mentions("Acme grows. acme does not. ACME", ["Acme"]) == [(0, 4), (27, 31)]
    assert R.find_mentions("The SAP system and sap of trees", ["SAP"]) == [(4, 7)]
    assert R.find_mentions("Delta Air Lines and Delta", ["Delta"], ["Delta Air Lines"]) == [(20, 25)]
    assert R.find_mentions("see WWW.Acme.com/x", [], domains=["acme.com"]) == [(8, 16)]


def test_quotes(spark):
    text = "The “new plant” — it costs 4,000 million euros — opens in May. Other words follow here."
    assert V.find_exact(text, 'the "NEW plant" - it costs') == (0, text.index("costs") + 5)
    assert V.find_exact(text, "short") is None
    assert V.find_fuzzy(text, "it costs 4,000 milion euros - opens in May") is not None
    assert V.find_fuzzy(text, "it costs 5,000 million euros - opens in May") is None
    assert V.find_exact(text, 'the "new plant" — it costs...') == (0, text.index("costs") + 5)
    assert V.find_fuzzy("other words folow here", "Other words follow here, then more") is not None  # cut off by the text's end
    for odd in ("  a\u00a0 b ", "ﬁne\tprint\n", "", " \n", "Straße “x”…"):
        form, places = V.normal_places(odd)
        assert form == " ".join("".join(unicodedata.normalize("NFKC", c).translate(V._SAME).casefold() for c in odd).split()) and len(places) == len(form)
    e = spark.createDataFrame([(text, "", "it costs 4,000 million euros"), (text, "Opens the new plant today", "opens the new plant today"), (text, "", "nothing like this at all in there")], "text string, title string, quote string")
    assert [r.found for r in V.locate_quotes(e).collect()] == ["exact", "title", None]


def test_ratios():
    assert V.lcs_length("abcde", "ace") == 3 and V.indel_ratio("abc", "abc") == 100 and V.indel_ratio("abc", "") == 0
    assert V.token_sort_ratio("b a", "a b") == 100 and V.token_set_ratio("a b c", "a b c d e") == 100
    rng = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 80))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if False else [*__import__("itertools").accumulate(range(1, len(b) + 1), lambda m, j: max(m, row[j], row[j - 1] + (x == b[j - 1])), initial=0)]
        assert V.lcs_length(a, b) == row[-1]


def test_clusters(spark):
    rows = [(1, "2024-01-01", "ACME cuts 400 jobs in Bonn this year", "a", 0.6), (2, "2024-01-05", "In Bonn ACME cuts 400 jobs this year", "b", 0.6), (3, "2024-03-05", "ACME cuts 400 jobs in Bonn this year", "c", 0.6), (4, None, "ACME cuts 400 jobs in Bonn, this year", "a", 0.5), (5, "2024-01-02", "ACME cuts 500 jobs in Bonn this year", "d", 0.9)]
    s = spark.createDataFrame([(1, *r, r[4]) for r in rows], "question_id int, signal_id int, date string, quote string, source_key string, confidence double, value double").withColumn("date", F.col("date").cast("date")).withColumn("summary", F.lit(None).cast("string"))
    keys = ["question_id"]
    members = V.single_linkage(s, V.similar_pairs(V.candidate_pairs(s, keys)))
    assert {r.signal_id: r.cluster for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}  # the undated one links both dates
    two = members.where("signal_id in (1, 2)")
    assert abs(V.cluster_confidence(two, keys).first().confidence - 0.84) < 1e-9
    same = members.where("signal_id in (1, 4)").withColumn("confidence", F.lit(0.8))
    assert abs(V.cluster_confidence(same, keys).first().confidence - 0.8) < 1e-9
    kept = V.keep_clusters(members, V.cluster_leads(members, keys), keys, most=1, each=2)
    assert {r.cluster for r in kept.collect()} == {1} and kept.first().corroborated  # three sources: 0.936


def test_answers_and_final(spark):
    raw = json.dumps([{"question_id": "q1", "answer": "yes", "confidence": 0.9, "evidence": [{"snippet_id": "S1", "quote": "x"}, {"snippet_id": "S2", "quote": "y"}]}, {"question_id": "q1", "answer": "no"}, {"question_id": "q2", "answer": "no", "confidence": 0.5, "evidence": []}])
    got = V.parse_answers(spark.createDataFrame([("c", "s", raw)], "company_id string, service_id string, answers string")).collect()
    assert sorted((r.question_id, r.answer, r.quote or "") for r in got) == [("q1", "yes", "x"), ("q1", "yes", "y"), ("q2", "no", "")]


def test_accounts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Organization Name,Website,Number of Employees,Headquarters Location,Industries,Tags\nAcme,https://www.acme.com/,10001+,\"Bonn, Nordrhein-Westfalen, Germany\",Health Care,a; b\nAcme 2,acme.com,1200,,,\n,beta.com,5,,,\nGamma,nodomain,5,,,\n")
    rows = A.read_accounts(spark, str(tmp_path)).withColumn("row", F.monotonically_increasing_id())
    good, bad = A.validate(rows)
    assert {(r.domain, r.employees) for r in good.collect()} == {("acme.com", 10001), ("acme.com", 1200)} and bad.count() == 2
    assert {tuple(r.problems) for r in bad.collect()} == {("no name",), ("bad domain",)}
    countries = spark.createDataFrame([("GERMANY", "DE"), ("DE", "DE")], "key string, code string")
    assert {r.country_code for r in A.country_match(good, countries).collect()} == {"DE", None}
    industries = spark.createDataFrame([("healthcare", "healthcare"), ("it services", "it_services")], "key string, id string")
    named = spark.createDataFrame([("Health Care",), ("IT Services",), ("Underwater basket weaving",), (None,)], "industry string")
    assert {r.industry: r.industry_id for r in A.industry_match(named, industries).collect()} == {"Health Care": "healthcare", "IT Services": "it_services", "Underwater basket weaving": None, None: None}
    r = spark.createDataFrame([(1, "a.com", None, "x"), (2, "a.com", 1200, "y")], "row int, domain string, employees int, name string")
    assert A.merge_duplicates(r).first().employees == 1200 and A.merge_duplicates(r, "skip").first().employees is None
    v = A.new_profile_version(spark.createDataFrame([(1, 3, True), (2, 1, True)], "service_id int, version int, is_current boolean"), spark.createDataFrame([(1,)], "service_id int"))
    assert {(x.service_id, x.version) for x in v.where("is_current").collect()} == {(1, 4), (2, 1)}


def raw(spark, *payloads):
    return spark.createDataFrame([(1, p if isinstance(p, str) else json.dumps(p)) for p in payloads], "company_id int, raw string")


def test_news(spark):
    since = F.lit("2024-01-01").cast("timestamp")
    arts = {"articles": [{"url": "https://a.com/x?utm_source=1", "title": "A", "seendate": "20240105T000000Z", "language": "German"}, {"url": "https://a.com/x", "title": "A", "seendate": "20240104T000000Z", "language": "German"}, {"url": "https://a.com/old", "title": "B", "seendate": "20230104T000000Z", "language": "English"}]}
    got = S.news_articles(raw(spark, arts), since).collect()
    assert [(r.canonical_url, r.language, r.headline_only) for r in got] == [("https://a.com/x", "de", True)]
    xml = "<rss><channel><item><title>Big news - Paper</title><link>https://p/1</link><description>&lt;b&gt;Big news&lt;/b&gt; Paper</description><pubDate>Sun, 20 Sep 2026 10:00:00 +0200</pubDate><source>Paper</source></item><item><title>BIG NEWS - Paper</title><link>https://p/2</link><source>Paper</source></item><item><title></title><link>https://p/3</link></item></channel></rss>"
    items = S.rss_items(raw(spark, xml))
    news = S.rss_news(items.where("title <> ''")).collect()
    assert [(r.title, r.headline_only) for r in news] == [("Big news", True)]
    assert sorted(r.url for r in S.rss_feed(items).collect()) == ["https://p/1", "https://p/2"]
    api = {"articles": [{"title": "[Removed]", "url": "u"}, {"title": "T", "url": "https://n/1", "content": "Body text… [+120 chars]", "publishedAt": "2024-01-02T00:00:00Z"}]}
    assert [(r.title, r.text) for r in S.newsapi_articles(raw(spark, api)).collect()] == [("T", "Body text")]
    search = S.search_results(raw(spark, {"organic_results": [{"title": "O", "link": "https://o", "snippet": "s"}]}, {"news_results": [{"title": "N", "link": "https://n"}, {"title": "N2", "link": "https://n"}]}), since).collect()
    assert sorted(r.title for r in search) == ["N", "O"]


def test_jobs(spark):
    boards = {
        "greenhouse": {"jobs": [{"title": "Dev", "content": "&lt;p&gt;Build&lt;/p&gt;", "absolute_url": "https://g/1", "updated_at": "2024-01-02T00:00:00Z", "location": {"name": "Bonn"}, "departments": [{"name": "IT"}]}]},
        "lever": [{"text": "Dev", "descriptionPlain": "Build", "hostedUrl": "https://l/1", "createdAt": 1704153600000, "categories": {"team": "IT", "location": "Bonn"}}],
        "ashby": {"jobs": [{"title": "Dev", "department": "IT", "location": "Bonn", "isListed": True, "jobUrl": "https://a/1", "descriptionPlain": "Build", "publishedAt": "2024-01-02T00:00:00Z"}, {"title": "Hidden", "isListed": False}]},
        "workable": {"jobs": [{"title": "Dev", "description": "<p>Build</p>", "url": "https://w/1", "published_on": "2024-01-02", "department": "IT", "city": "Bonn"}]},
        "recruitee": {"offers": [{"title": "Dev", "status": "published", "description": "<p>Build</p>", "careers_url": "https://r/1", "published_at": "2024-01-02 00:00:00 UTC", "department": "IT", "location": "Bonn"}, {"title": "Draft", "status": "draft"}]},
        "aggregator": {"results": [{"title": "Dev", "description": "Build", "created": "2024-01-02T00:00:00Z", "redirect_url": "https://z/1", "category": {"label": "IT"}, "location": {"display_name": "Bonn"}}]},
    }
    for kind, payload in boards.items():
        rows = S.job_postings(raw(spark, payload), kind).collect()
        assert [(r.title, r.text, str(r.published_at)) for r in rows] == [("Dev", "IT\nBonn\nBuild", "2024-01-02 00:00:00")], kind
    xml = "<workzag-jobs><position><id>7</id><office>Bonn</office><department>IT</department><name>Dev</name><jobDescriptions><jobDescription><name>n</name><value>&lt;p&gt;Build&lt;/p&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>"
    assert S.personio_postings(raw(spark, xml)).first().text == "IT\nBonn\nBuild"
    d = spark.createDataFrame([(1, "/p/1", json.dumps({"jobPostingInfo": {"title": "Dev", "jobDescription": "<p>Build</p>", "location": "Bonn"}}))], "company_id int, path string, raw string")
    w = S.workday_postings(raw(spark, {"jobPostings": [{"title": "Dev", "externalPath": "/p/1"}, {"title": "Dev", "externalPath": "/p/1"}, {"title": "Ops", "externalPath": "/p/2", "locationsText": "Köln"}]}), d).collect()
    assert sorted((r.title, r.text) for r in w) == [("Dev", "Bonn\nBuild"), ("Ops", "Köln")]
    d = spark.createDataFrame([(1, "9", json.dumps({"jobAd": {"sections": {"a": {"text": "<p>Build</p>"}}}, "postingUrl": "https://s/9"}))], "company_id int, id string, raw string")
    assert S.smartrecruiters_postings(raw(spark, {"content": [{"id": "9", "name": "Dev", "location": {"city": "Bonn"}, "function": {"label": "IT"}}]}), d).first().text == "IT\nBonn\nBuild"
    jobs = spark.createDataFrame([(1, 0, "Chef", "Acme Food GmbH"), (1, 1, "Data engineer", "ACME Group"), (1, 2, "Cook", "Other")], "company_id int, position int, title string, employer string")
    assert [r.title for r in S.prioritise(jobs, ["data"], 2).orderBy(F.desc("position")).collect()] == ["Data engineer", "Chef"]
    assert {r.title for r in S.employer_filter(jobs, spark.createDataFrame([(1, "Acme AG")], "company_id int, name string")).collect()} == {"Chef", "Data engineer"}


def test_registries(spark):
    b = [{"Name": "X", "Title": "X leak", "Domain": "mail.acme.com", "BreachDate": "2023-01-01", "AddedDate": "2023-05-01T00:00:00Z", "PwnCount": 5, "DataClasses": ["Emails"], "Description": "<p>Leak</p>"}, {"Name": "Y", "Domain": "acme.com", "IsSpamList": True, "AddedDate": "2023-05-01T00:00:00Z"}, {"Name": "Z", "Domain": "notacme.com", "AddedDate": "2023-05-01T00:00:00Z"}]
    c = spark.createDataFrame([(1, "Acme AG", "acme.com", None)], "company_id int, name string, domain string, own_domains array<string>")
    docs = S.incident_docs(raw(spark, b).select("raw"), c, F.lit("2023-01-01").cast("timestamp")).collect()
    assert [(r.title, r.text) for r in docs] == [("X leak", "Breach date: 2023-01-01\nAccounts: 5\nData: Emails\nLeak")]
    v = lambda x: {"value": x}
    sparql = {"results": {"bindings": [{"item": v("Q1"), "itemLabel": v("Acme"), "employees": v("10"), "founded": v("1999-01-01"), "industries": v("http://e/Q5,http://e/Q6")}, {"item": v("Q1"), "itemLabel": v("Acme"), "employees": v("30"), "revenue": v("7.5"), "founded": v("2001")}]}}
    f = S.firmographics(raw(spark, sparql), spark.createDataFrame([("Q5", "food")], "qid string, industry_id string")).first()
    assert (f.employees, f.revenue_eur, f.founded, f.industry_ids) == (30, 7, 1999, ["food"])
    lei = {"data": [{"id": "1", "attributes": {"lei": "L1", "entity": {"legalName": {"name": "ACME Aktiengesellschaft AG"}, "legalAddress": {"country": "DE"}, "status": "ACTIVE"}, "registration": {"status": "ISSUED"}}}, {"id": "2", "attributes": {"lei": "L2", "entity": {"legalName": {"name": "The Acme GmbH"}, "status": "ACTIVE"}, "registration": {"status": "ISSUED"}}}]}
    m = S.match_legal_entity(c, S.legal_entities(raw(spark, lei)))
    assert [r.lei for r in m.collect()] == ["L2"]
    reg = S.registry_docs(m, spark.createDataFrame([("L2", "L0", "Parent SE")], "lei string, parent_lei string, parent_name string")).first()
    assert "Parent: Parent SE" in reg.text and reg.source_type == "registry"
    a, x = (spark.createDataFrame(r, "company_id int, employees int, country string") for r in ([(1, None, "DE")], [(1, 5, "FR"), (2, 6, None)]))
    assert sorted(map(tuple, S.coalesce_firmographics(a, x, ["employees", "country"]).collect())) == [(1, 5, "DE"), (2, 6, None)]
    hits = spark.createDataFrame([(1, 0, "Q1", "https://other.org"), (1, 1, "Q2", "https://www.acme.com/")], "company_id int, position int, entity_id string, website string")
    assert S.pick_entity(hits, c).first().entity_id == "Q2"
    assert '"employees":30' in S.firmographic_docs(spark.createDataFrame([(1, "Acme", 30)], "company_id int, name string, employees int")).first().text


def test_web(spark):
    html = '<html><head><title>T &amp; U</title></head><body><nav><a href="/x">x</a></nav><p>' + "Long body text. " * 30 + '</p><a href="/news/2024/big">Big story</a><a href="https://boards.greenhouse.io/acme/jobs/1">Open position</a><a href="careers/dev">Developer role</a></body></html>'
    p = spark.createDataFrame([(1, "https://acme.com/news", html)], "company_id int, url string, html string")
    d = W.page_documents(p).first()
    assert d.title == "T & U" and d.text.startswith("Long body text.")
    assert [r.url for r in W.links(p).orderBy("position").collect()] == ["https://acme.com/x", "https://acme.com/news/2024/big", "https://boards.greenhouse.io/acme/jobs/1", "https://acme.com/careers/dev"]
    assert [r.url for r in W.article_links(p).collect()] == ["https://acme.com/news/2024/big"]
    assert (W.detect_ats(p).first().ats, W.detect_ats(p).first().token) == ("greenhouse", "acme")
    assert {r.title for r in W.careers_links(p).collect()} == {"Open position", "Developer role"}
    kinds = spark.createDataFrame([("https://a.com/en/newsroom/x",), ("https://a.com/directions",), ("https://a.com/ir/x",), ("https://a.com/our-strategy-2030",)], "url string").select(W.page_kind(F.col("url")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["news", "other", "ir", "strategy"]
    own = W.links(p).withColumn("domain", F.lit("acme.com"))
    assert W.pick_links(own, "careers", ["boards.greenhouse.io"]).first().url == "https://acme.com/careers/dev"
    m = spark.createDataFrame([(1, "acme.com", 0, "<urlset><url><loc>https://acme.com/a</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://else.com/b</loc></url></urlset>")], "company_id int, domain string, file int, raw string")
    got = W.sitemap_urls(m, spark.createDataFrame([(1, "https://acme.com/a"), (1, "https://acme.com/c")], "company_id int, url string")).collect()
    assert {(r.url, r.lastmod is not None) for r in got} == {("https://acme.com/a", True), ("https://acme.com/c", False)}
    pages = spark.createDataFrame([(1, i, ("risk " if i in (3, 7) else "x ") * 10) for i in range(10)], "doc_id int, page int, text string")
    assert sorted(r.page for r in W.select_report_pages(pages, ["risk"], 170).collect()) == [2, 3, 4, 6, 7]


def test_leads_and_events(spark, tmp_path):
    k = spark.createDataFrame([("distress", "Stellenabbau in Bonn"), ("tech_stack", ""), ("investment", "x"), ("distress", "debt")], "category string, quote string").select(L.trend_kind(F.col("category"), F.col("quote")).alias("k"))
    assert [r.k for r in k.collect()] == ["layoffs", None, "growth", "distress"]
    L.export_leads(spark.createDataFrame([(1, ["a", "b"])], "company_id int, reasons array<string>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().reasons == "a; b"
    scope = lambda c, n: spark.range(1).select(E.firmographic_scope(F.array(F.lit("DE")), F.lit(10), F.lit(None).cast("int"), F.lit(c).cast("string"), F.lit(n).cast("int")).alias("x")).first().x
    assert scope("DE", 10) and not scope("DE", None) and not scope(None, 20)
    assert spark.range(1).select(E.in_scope(F.lit(None).cast("array<int>"), F.lit(1)).alias("x")).first().x
    found = spark.createDataFrame([(1, 1), (1, 2)], "rule_id int, company_id int")
    sent = spark.createDataFrame([(1, 1, "2024-01-30")], "rule_id int, company_id int, notified_at string")
    assert [r.company_id for r in E.once_per_window(found, sent, F.lit("2024-01-29")).collect()] == [2]


def test_fuzzy_quotes_are_the_best_of_all_windows():
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    found = 0
    for _ in range(60):
        quote = filler(9)
        near = list(quote)
        for k in range(3, len(near), 17):
            near[k] = "x"
        text = f"{filler(12)} {''.join(near)} {filler(12)} {quote[:25]} {filler(12)}"
        body, wanted = V.normal_places(text)[0], V.wanted_form(quote)
        n = len(wanted)
        best, at = max((V.indel_ratio(wanted, body[s : s + n]), -s) for s in range(len(body) - n + 1))
        assert V.find_fuzzy(text, quote) == ((-at, -at + n) if best >= 90 else None)
        found += best >= 90
    assert found > 50


def slow_chunks(words: list[int]) -> list[tuple[int, int]]:
    """Sentence by sentence, as the rule is said: closed when it has enough words and the next sentence is too much."""
    out, start, i = [], 0, 0
    while i < len(words):
        if i > start and sum(words[start:i]) >= 120 and sum(words[start : i + 1]) > 220:
            out.append((start, i))
            start = i - 1 if words[i - 1] + words[i] <= 220 else i
        i += 1
    if out and sum(words[start:]) < 60:
        out[-1] = (out[-1][0], len(words))
    elif words:
        out.append((start, len(words)))
    return out


def test_chunk_bounds_are_the_rule():
    rng = random.Random(6)
    for _ in range(400):
        words = [rng.choice([1, 5, 30, 90, 100, 119, 120, 150, 219, 220]) if rng.random() < 0.5 else rng.randint(1, 60) for _ in range(rng.randint(0, 40))]
        assert R.chunk_bounds(words) == slow_chunks(words)
    assert R.chunk_bounds([100, 150]) == [(0, 2)]  # goes on while it is short


def test_sentences_leave_closing_quotes_out():
    text = 'He said "Yes." Then (no!) more… end'
    assert [text[a:b] for a, b in R.sentence_spans(text)] == ['He said "Yes.', "Then (no!", "more…", "end"]


def test_names_of_places_are_no_mentions():
    assert R.find_mentions("Orange County and East Orange, but Orange grows", ["Orange"]) == [(35, 41)]
    assert R.find_mentions("Orange County Choppers", ["Orange", "Orange County"])[0] == (0, 6)
    assert R.find_mentions("Müller and MULLER", ["Müller"]) == [(0, 6), (11, 17)]


def test_own_sources(spark):
    rows = [("news", "", "https://blog.acme.com/x"), ("website", "", "https://other.org"), ("jobs", "greenhouse", "https://x.io"), ("jobs", "adzuna", "https://x.io"), ("incident", "", None)]
    df = spark.createDataFrame([(*r, ["www.acme.com"]) for r in rows], "source_type string, source_name string, url string, domains array<string>")
    assert [r.own for r in df.select(R.own_source(df.columns).alias("own")).collect()] == [True, False, True, False, True]


def test_rank_fusion_is_the_formula(spark):
    rng = random.Random(9)
    bm = {(q, c): rng.random() * 9 for q in range(3) for c in rng.sample(range(60), 35)}
    cos = {(q, c): rng.uniform(0.5, 1) for q in range(3) for c in range(60)}
    got = {(r.question_id, r.chunk_id): r.rrf for r in R.rank_fusion(*(spark.createDataFrame([(*k, v) for k, v in x.items()], f"question_id int, chunk_id int, {n} double") for x, n in ((bm, "bm25"), (cos, "cos"))), []).collect()}
    want = {}
    for q in range(3):
        top = [{c: n + 1 for n, (_, c) in enumerate(sorted((-v, c) for (p, c), v in x.items() if p == q)[:20])} for x in (bm, cos)]
        for c in set(top[0]) | set(top[1]):
            if (q, c) in bm or cos[q, c] >= 0.78:
                want[q, c] = sum(1 / (60 + t[c]) for t in top if c in t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_same_quote_of_a_source_is_one_event(spark):
    rows = [(1, 1, "2024-01-01", "ACME opens", None, "d", "s"), (1, 2, "2024-06-01", "ACME opens", None, "d", "s"), (1, 3, "2024-01-01", "plant costs 4,000 jobs", "also 5.0 in all", "e", "t"), (1, 4, "2024-01-03", "plant costs 4000 jobs", "50 in all too", "f", "u"), (1, 5, "2024-01-03", "plant costs 400 jobs", None, "g", "v")]
    s = spark.createDataFrame(rows, "q int, signal_id int, date string, quote string, summary string, document_id string, source_key string").withColumn("date", F.col("date").cast("date"))
    members = V.single_linkage(s, V.similar_pairs(V.candidate_pairs(s, ["q"])))
    assert {r.signal_id: r.cluster for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_industries_by_likeness(spark):
    from accountlens.operators import accounts as A

    df = spark.createDataFrame([("Banking",), ("bankin",), ("oil and gas",), ("gas and oil",), ("zzz",), (None,)], "industry string")
    known = spark.createDataFrame([("banking", "b"), ("oil and gas", "o"), ("gas", "g")], "key string, id string")
    assert {r.industry: r.industry_id for r in A.industry_match(df, known).collect()} == {"Banking": "b", "bankin": "b", "oil and gas": "o", "gas and oil": "o", "zzz": None, None: None}
