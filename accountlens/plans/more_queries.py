"""Queries for the remaining operators: payloads, fields, scopes and parameters derived from the driver's tables inside the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounts as A
from ..operators import dedup as D
from ..operators import events as E
from ..operators import leads as L
from ..operators import retrieval as R
from ..operators import scoring as G
from ..operators import verify as V
from ..sources import landing as S
from ..sources import web as W
from .demo import view, with_views
from .scoring_queries import ICP, companies, rounded, signals

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: tuple = ()):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return f

    return put


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark, d):
    return table(spark, d, "customer")


def text(column):
    return F.col(column).cast("string")


# Landed payloads -----------------------------------------------------------------------------------------------
def rss(spark, d):
    xml = F.format_string("<rss><channel><item><title>Story %d - Paper</title><link>https://p.example/%d</link><description>&lt;b&gt;Text %d&lt;/b&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><source>Paper</source></item><item><title>STORY %d - Paper</title><link>https://p.example/x%d</link><source>Paper</source></item></channel></rss>", *[F.col("c_custkey")] * 5)
    return customers(spark, d).select(F.col("c_custkey").alias("company_id"), xml.alias("raw"))


@query("s03_rss_items", "select c_custkey as company_id, cast(i as int) as position, 'https://p.example/' || case when i = 1 then 'x' else '' end || c_custkey as url from customer, range(2) t(i)")
def rss_items(spark, d):
    return S.rss_items(rss(spark, d)).select("company_id", "position", "url")


@query("s04_rss_news", "select c_custkey as company_id, 'Story ' || c_custkey as title, 'Text ' || c_custkey as text from customer")
def rss_news(spark, d):
    return S.rss_news(S.rss_items(rss(spark, d))).select("company_id", "title", "text")


@query("s05_rss_feed", "select c_custkey as company_id, count(*) as n from customer, range(2) group by all")
def rss_feed(spark, d):
    return S.rss_feed(S.rss_items(rss(spark, d))).groupBy("company_id").agg(F.count("*").alias("n"))


@query("s06_newsapi", "select c_custkey as company_id, 'Title ' || c_custkey as title, 'Body ' || c_custkey as text from customer where c_custkey % 3 <> 0")
def newsapi(spark, d):
    art = F.struct(F.when(F.col("c_custkey") % 3 == 0, "[Removed]").otherwise(F.concat(F.lit("Title "), text("c_custkey"))).alias("title"), F.lit("https://n.example").alias("url"), F.concat(F.lit("Body "), text("c_custkey"), F.lit("… [+99 chars]")).alias("content"), F.lit("2024-01-02T00:00:00Z").alias("publishedAt"))
    raw = customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.to_json(F.struct(F.array(art).alias("articles"))).alias("raw"))
    return S.newsapi_articles(raw).select("company_id", "title", "text")


@query("s07_search_results", "select c_custkey as company_id, case when c_custkey % 2 = 0 then 'News ' else 'Page ' end || c_custkey as title from customer")
def search_results(spark, d):
    item = lambda kind: F.array(F.struct(F.concat(F.lit(kind), text("c_custkey")).alias("title"), F.lit("https://s.example").alias("link")))
    body = F.struct(F.when(F.col("c_custkey") % 2 == 0, item("News ")).alias("news_results"), item("Page ").alias("organic_results"))
    return S.search_results(customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.to_json(body).alias("raw")), F.lit("2024-01-01").cast("timestamp")).select("company_id", "title")


BOARD = {
    "greenhouse": lambda i, n: F.struct(F.array(F.struct(n.alias("title"), F.lit("&lt;p&gt;Build&lt;/p&gt;").alias("content"), i.alias("absolute_url"), F.array(F.struct(F.lit("IT").alias("name"))).alias("departments"))).alias("jobs")),
    "lever": lambda i, n: F.array(F.struct(n.alias("text"), F.lit("Build").alias("descriptionPlain"), i.alias("hostedUrl"), F.struct(F.lit("IT").alias("team")).alias("categories"))),
    "ashby": lambda i, n: F.struct(F.array(F.struct(n.alias("title"), F.lit("IT").alias("department"), F.lit(True).alias("isListed"), i.alias("jobUrl"), F.lit("Build").alias("descriptionPlain"))).alias("jobs")),
    "workable": lambda i, n: F.struct(F.array(F.struct(n.alias("title"), F.lit("<p>Build</p>").alias("description"), i.alias("url"), F.lit("IT").alias("department"))).alias("jobs")),
    "recruitee": lambda i, n: F.struct(F.array(F.struct(n.alias("title"), F.lit("published").alias("status"), F.lit("<p>Build</p>").alias("description"), i.alias("careers_url"), F.lit("IT").alias("department"))).alias("offers")),
    "aggregator": lambda i, n: F.struct(F.array(F.struct(n.alias("title"), F.lit("Build").alias("description"), i.alias("redirect_url"), F.struct(F.lit("IT").alias("label")).alias("category"))).alias("results")),
}


@query("s08_job_boards", "select p_partkey as company_id, b as source_name, p_name as title, 'IT' || chr(10) || 'Build' as text from part, (values ('greenhouse'), ('lever'), ('ashby'), ('workable'), ('recruitee'), ('aggregator')) v(b)")
def job_boards(spark, d):
    """The parts as postings of six boards' payloads."""
    out = None
    for kind, payload in BOARD.items():
        raw = table(spark, d, "part").select(F.col("p_partkey").alias("company_id"), F.to_json(payload(F.concat(F.lit("https://j.example/"), text("p_partkey")), F.col("p_name"))).alias("raw"))
        one = S.job_postings(raw, kind).select("company_id", "source_name", "title", "text")
        out = one if out is None else out.unionByName(one)
    return out


@query("s08c_workday", "select p_partkey as company_id, p_name as title, case when p_partkey % 2 = 0 then 'Bonn' || chr(10) || 'Build' else 'Remote' end as text from part")
def workday(spark, d):
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("/p/"), text("p_partkey"))).withColumnRenamed("p_partkey", "company_id")
    item = F.struct(F.col("p_name").alias("title"), F.col("path").alias("externalPath"), F.lit("Remote").alias("locationsText"))
    lists = p.select("company_id", F.to_json(F.struct(F.array(item, item).alias("jobPostings"))).alias("raw"))
    info = F.struct(F.struct(F.col("p_name").alias("title"), F.lit("<p>Build</p>").alias("jobDescription"), F.lit("Bonn").alias("location")).alias("jobPostingInfo"))
    return S.workday_postings(lists, p.where("company_id % 2 = 0").select("company_id", "path", F.to_json(info).alias("raw"))).select("company_id", "title", "text")


@query("s08d_personio", "select p_partkey as company_id, p_name as title, 'IT' || chr(10) || 'Bonn' || chr(10) || 'Build' as text from part")
def personio(spark, d):
    xml = F.format_string("<workzag-jobs><position><id>%d</id><office>Bonn</office><department>IT</department><name>%s</name><jobDescriptions><jobDescription><name>n</name><value>&lt;p&gt;Build&lt;/p&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>", "p_partkey", "p_name")
    return S.personio_postings(table(spark, d, "part").select(F.col("p_partkey").alias("company_id"), xml.alias("raw"))).select("company_id", "title", "text")


@query("s09_prioritise", "select p_size as company_id, p_partkey, cast(row_number() over (partition by p_size order by contains(lower(p_name), 'red') desc, p_partkey) as bigint) as nth from part qualify nth <= 3")
def prioritise(spark, d):
    from pyspark.sql import Window

    jobs = table(spark, d, "part").select(F.col("p_size").alias("company_id"), "p_partkey", F.col("p_name").alias("title"), F.col("p_partkey").alias("position"))
    order = Window.partitionBy("company_id").orderBy(F.desc(F.lower("title").contains("red")), "position")
    return S.prioritise(jobs, ["red"], 3).select("company_id", "p_partkey", F.row_number().over(order).cast("bigint").alias("nth"))


@query("s10_employer_filter", "select c_custkey as company_id from customer where c_custkey % 4 <> 0")
def employer_filter(spark, d):
    c = customers(spark, d)
    jobs = c.select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_custkey") % 4 == 0, "Someone Else GmbH").otherwise(F.concat(F.lit("The "), "c_name", F.lit(" Services AG"))).alias("employer"))
    return S.employer_filter(jobs, c.selectExpr("c_custkey as company_id", "concat(c_name, ' GmbH') as name")).select("company_id")


@query("s14_firmographics", "select n_nationkey, cast(max(floor(greatest(c_acctbal, 0))) as bigint) as employees, string_agg(distinct lower(c_mktsegment), ',' order by lower(c_mktsegment)) as industries from customer join nation on c_nationkey = n_nationkey group by all")
def firmographics(spark, d):
    v = lambda c: F.struct(c.cast("string").alias("value"))
    b = F.struct(v(F.col("c_nationkey")).alias("item"), v(F.floor(F.greatest("c_acctbal", F.lit(0.0)))).alias("employees"), v(F.concat(F.lit("http://e/"), "c_mktsegment")).alias("industries"))
    raw = customers(spark, d).select(F.to_json(F.struct(F.struct(F.array(b).alias("bindings")).alias("results"))).alias("raw"))
    taxonomy = customers(spark, d).selectExpr("c_mktsegment as qid", "lower(c_mktsegment) as industry_id").distinct()
    return S.firmographics(raw, taxonomy).select(F.col("item").cast("int").alias("n_nationkey"), "employees", F.array_join("industry_ids", ",").alias("industries"))


@query("s16_registry_docs", "select c_custkey as company_id, 'LEI: L' || c_custkey || chr(10) || 'Legal name: ' || c_name || chr(10) || 'Status: ACTIVE' || case when c_custkey % 2 = 0 then chr(10) || 'Parent: ' || c_mktsegment else '' end as text from customer")
def registry_docs(spark, d):
    m = customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("L"), text("c_custkey")).alias("lei"), F.col("c_name").alias("legal_name"), F.lit("ACTIVE").alias("status"), "c_mktsegment")
    parents = m.where("company_id % 2 = 0").select("lei", F.lit("P").alias("parent_lei"), F.col("c_mktsegment").alias("parent_name"))
    return S.registry_docs(m.drop("c_mktsegment"), parents).select("company_id", "text")


@query("s17_coalesce_firmographics", "select c_custkey as company_id, case when c_custkey % 3 = 0 then c_nationkey else c_custkey end as employees from customer")
def coalesce_firmographics(spark, d):
    c = customers(spark, d)
    a = c.selectExpr("c_custkey as company_id", "if(c_custkey % 3 = 0, null, c_custkey) as employees")
    return S.coalesce_firmographics(a, c.selectExpr("c_custkey as company_id", "cast(c_nationkey as bigint) as employees"), ["employees"])


@query("s32_sitemaps", "select page_id % 50 as company_id, 'https://own.example/' || page_id as url, page_id % 2 = 0 as dated from pages")
def sitemaps(spark, d):
    p = table(spark, d, "pages").withColumn("company_id", F.col("page_id") % 50)
    xml = F.format_string("<urlset><url><loc>https://own.example/%d</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://other.example/%d</loc></url></urlset>", "page_id", "page_id")
    raw = p.where("page_id % 2 = 0").select("company_id", F.lit("own.example").alias("domain"), F.col("page_id").alias("file"), xml.alias("raw"))
    anchors = p.select("company_id", F.concat(F.lit("https://own.example/"), text("page_id")).alias("url"))
    return W.sitemap_urls(raw, anchors, files=100_000, n=100_000).select("company_id", "url", F.col("lastmod").isNotNull().alias("dated"))


@query("s33_pick_entity", "select c_custkey as company_id, case when c_custkey % 2 = 0 then 'own' else 'first' end as entity_id from customer")
def pick_entity(spark, d):
    c = customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("c"), text("c_custkey"), F.lit(".example")).alias("domain"))
    hits = c.select("company_id", F.lit(0).alias("position"), F.lit("first").alias("entity_id"), F.lit("https://else.example").alias("website")).unionByName(
        c.where("company_id % 2 = 0").select("company_id", F.lit(1).alias("position"), F.lit("own").alias("entity_id"), F.concat(F.lit("https://www."), "domain", F.lit("/home")).alias("website")))
    return S.pick_entity(hits, c)


# Fields --------------------------------------------------------------------------------------------------------
@query("c05_dates", "select o_orderkey, cast(o_orderdate as date) as day from orders")
def dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T12:30:00Z"))).otherwise(F.concat(F.date_format("o_orderdate", "E, d MMM yyyy"), F.lit(" 12:30:00 +0000")))
    return table(spark, d, "orders").select("o_orderkey", T.utc_datetime(said).cast("date").alias("day"))


@query("c12_c14_quotes", "select signal_id, lower(quote) as quote from signal", ("signal",))
def normal_quotes(spark, d):
    return signals(spark, d).select("signal_id", T.normal_quote(F.concat(F.lit("  "), F.replace("quote", F.lit(" "), F.lit("\t ")))).alias("quote"))


@query("c18_c20_names", "select c_custkey, c_name || ' GmbH,' || c_name as variants, c_name as search_name from customer")
def names(spark, d):
    full = F.concat("c_name", F.lit(" GmbH"))
    return customers(spark, d).select("c_custkey", F.array_join(T.name_variants(full), ",").alias("variants"), T.search_name(F.lit("ABC"), F.lit(None).cast("string"), F.array(F.lit("x"), F.col("c_name"))).alias("search_name"))


@query("c22_c23_matches", "select c_custkey, 'N' || c_nationkey as country_code, lower(c_mktsegment) as industry_id from customer")
def matches(spark, d):
    c = customers(spark, d).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.concat(F.lit("Town, Region, "), F.initcap("n_name")).alias("country_code"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("s"))).alias("industry"))
    countries = table(spark, d, "nation").select("n_name", F.concat(F.lit("N"), text("n_nationkey")).alias("code")).withColumnRenamed("n_name", "key")
    industries = customers(spark, d).selectExpr("lower(c_mktsegment) as key", "lower(c_mktsegment) as id").distinct()
    return A.industry_match(A.country_match(rows, countries), industries).select("c_custkey", "country_code", "industry_id")


@query("c24_c25_gists", "select signal_id, quote || '.' as gist, 'https://app.example/leads/' || company_id || '?service=' || service_id as link from signal", ("signal",))
def gists(spark, d):
    return signals(spark, d).select("signal_id", T.gist(F.concat("quote", F.lit(". And more follows here."))).alias("gist"), T.lead_link("https://app.example/", F.col("company_id"), F.col("service_id")).alias("link"))


@query("c28_report_dates", "select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) else date '2021-01-01' end as day from orders")
def report_dates(spark, d):
    meta = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'D:'yyyyMMdd")).otherwise("D:2021")
    return table(spark, d, "orders").select("o_orderkey", T.report_date(F.when(F.col("o_orderkey") % 4 != 3, meta), F.lit("https://x/2019/report-2021.pdf")).cast("date").alias("day"))


@query("d11_collect_plan", "select signal_id % 2 as service_id, cast(max(30 + question_id * 10) as int) as days, string_agg(distinct source_type, ',' order by source_type) as sources from signal group by all", ("signal",))
def collect_plan(spark, d):
    q = signals(spark, d).select((F.col("signal_id") % 2).alias("service_id"), F.array("source_type").alias("source_types"), (30 + F.col("question_id") * 10).cast("int").alias("recency_days"), F.create_map(F.lit("en"), F.array("category")).alias("keywords"))
    return D.collect_plan(q).select("service_id", "days", F.array_join("source_types", ",").alias("sources"))


# Retrieval, verification ---------------------------------------------------------------------------------------
@query("r04_attach_embeddings", "select vec_id as chunk_id, len(embedding) as n from embeddings where vec_id % 2 = 0")
def attach_embeddings(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return R.attach_embeddings(e.where("chunk_id % 2 = 0").select("chunk_id"), e).select("chunk_id", F.size("embedding").cast("bigint").alias("n"))


@query("r07_question_queries", "select item_id as question_id, text || ' alpha beta Engineer' as query from benchmark")
def question_queries(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.create_map(F.lit("en"), F.array(F.lit("alpha"), F.lit("beta")), F.lit("de"), F.array(F.lit("alpha"))).alias("keywords"), F.array(F.lit("Engineer")).alias("job_titles"))
    return R.question_query(q)


@query("v01_parse_answers", "select company_id, question_id, min(quote) as quote from signal group by all", ("signal",))
def parse_answers(spark, d):
    first = signals(spark, d).groupBy("company_id", "question_id").agg(F.min("quote").alias("quote"))
    a = lambda q: F.struct(text("question_id").alias("question_id"), F.lit("yes").alias("answer"), F.lit(0.9).alias("confidence"), F.array(F.struct(q.alias("quote"))).alias("evidence"))
    raw = first.groupBy("company_id", F.lit(1).alias("service_id")).agg(F.to_json(F.flatten(F.collect_list(F.array(a(F.col("quote")), a(F.lit("second")))))).alias("answers"))
    return V.parse_answers(raw).select("company_id", F.col("question_id").cast("bigint").alias("question_id"), "quote")


@query("v04_subject_check", "select signal_id, signal_id % 5 = 0 or abs(signal_id % 1000 - 500) < 300 or (signal_id % 3 = 0 and signal_id % 1000 <= 300) as ok from signal", ("signal",))
def subject_check(spark, d):
    at = (F.col("signal_id") % 1000).cast("int")
    mention = F.array(F.struct(F.lit(500).alias("s"), F.lit(500).alias("e")))
    return signals(spark, d).select("signal_id", V.subject_ok(F.col("signal_id") % 5 == 0, mention, F.col("signal_id") % 3 == 0, at, at).alias("ok"))


@query("v09_keep_clusters", """+ m as (select signal_id, company_id, evidence_key as cluster, cast(confidence as double) as value, source_type from signal where status = 'active'),
b as (select company_id, cluster, source_type, max(value) as c from m group by all),
l as (select company_id, cluster, case when count(*) > 1 then greatest(max(c), least(0.98, 1 - product(1 - c))) else max(c) end as v, count(*) as n from b group by company_id, cluster qualify row_number() over (partition by company_id order by round(v, 9) desc, cluster) <= 3)
select signal_id, company_id, n > 1 as corroborated from m join l using (company_id, cluster) qualify row_number() over (partition by company_id, cluster order by value desc, signal_id) <= 3""", ("signal",))  # fmt: skip
def keep_clusters(spark, d):
    m = signals(spark, d).where("status = 'active'").select("signal_id", "company_id", F.col("evidence_key").alias("cluster"), F.col("confidence").alias("value"), "confidence", F.col("source_type").alias("source_key"))
    return V.keep_clusters(m, V.cluster_leads(m, ["company_id"]), ["company_id"]).select("signal_id", "company_id", "corroborated")


# Scoring, leads, events, accounts ------------------------------------------------------------------------------
@query("g09_g10_priority_tiers", "select score_id, round(100 * pow(fit / 100, 0.4) * pow(intent / 100, 0.6) * (1 - 0.5 * (priority / 100)), 6) as p, case when round_even(100 * pow(fit / 100, 0.4) * pow(intent / 100, 0.6) * (1 - 0.5 * (priority / 100)), 1) >= 65 then 'hot' when round_even(100 * pow(fit / 100, 0.4) * pow(intent / 100, 0.6) * (1 - 0.5 * (priority / 100)), 1) >= 40 then 'warm' else 'cold' end as tier from score", ("score",))
def priority_tiers(spark, d):
    p = G.priority(F.col("fit").cast("double"), F.col("intent").cast("double"), F.col("priority").cast("double"))
    return view(spark, d, "score").select("score_id", rounded(p).alias("p"), G.tier(p, F.lit(False)).alias("tier"))


@query("g17_list_rules", "select company_id, company_id in (3, 5) as listed from company", ("company",))
def list_rules(spark, d):
    listed = F.array(F.lit("customer-000000003.example"), F.lit("alias5.example"))
    own = F.when(F.col("company_id") == 5, F.array(F.lit("alias5.example")))
    return view(spark, d, "company").select("company_id", G.list_rule(F.col("domain"), own, listed).alias("listed"))


@query("g18_signal_rules", "select company_id, 'r' as name from signal where status = 'active' group by company_id having max(confidence) >= 0.9", ("signal",))
def signal_rules(spark, d):
    strengths = signals(spark, d).where("status = 'active'").groupBy("company_id").agg(F.max("confidence").alias("s")).withColumn("service_id", F.lit(1)).withColumn("question_key", F.lit("q1"))
    rules = view(spark, d, "rule").limit(1).select(F.lit("question").alias("kind"), F.lit("r").alias("name"), F.lit(1).alias("service_id"), F.lit("q1").alias("question_key"), F.lit(0.9).alias("min_strength"))
    return G.signal_rule(strengths, rules).select("company_id", "name")


@query("g21_refresh_derived", "select c_custkey as company_id, case when c_custkey % 2 = 0 then 'old' else 'new' end as kept from customer")
def refresh_derived(spark, d):
    base = customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.lit(1).alias("service_id"), F.lit(1).alias("question_id"), F.lit("nis2").alias("source_name"), F.lit("derived").alias("source_type"))
    stored = base.where("company_id % 2 = 0").withColumn("signal_id", F.lit("old"))
    return G.refresh_derived(stored, base.withColumn("signal_id", F.lit("new"))).select("company_id", F.col("signal_id").alias("kept"))


@query("g25_rescore_company", "select score_id % 3 as is_three, count(*) as n from score where company_id = 7 group by all", ("score",))
def rescore_company(spark, d):
    s = view(spark, d, "score").select("company_id", "service_id", "score_id", F.lit("cold").alias("tier"))
    done, _ = G.rescore_company(s.where("false").withColumn("is_current", F.lit(True)), s, 7)
    return done.groupBy((F.col("score_id") % 3).alias("is_three")).agg(F.count("*").alias("n"))


@query("g28_parameters", """with p as (select c_custkey, c_custkey % 3 <> 0 and c_custkey % 5 <> 0 and c_custkey % 7 <> 0 as valid from customer)
select c_custkey, valid, cast(case when valid then c_custkey + 1 else 5 end as double) as tau_intent, cast(case when valid then 2 * (c_custkey % 4 + 1) else 3 end as double) as high, cast(case when valid and c_custkey % 2 = 1 then 0.1 else 0.4 end as double) as fit_exponent,
  cast(case when valid and c_custkey % 2 = 0 then 30 else 45 end as double) as jobs, cast(case when valid then 50 + c_custkey % 7 else 65 end as double) as hot, cast(3 as double) as max_evidence_per_question from p""")  # fmt: skip
def parameters(spark, d):
    k = F.col("c_custkey")
    tau = F.when(k % 3 == 0, F.lit(-1.0)).otherwise(k + 1.0)
    weights = F.create_map(F.lit("high"), 2.0 * (k % 4 + 1), F.lit("medium"), F.lit(1.0), F.lit("low"), F.lit(0.5))
    tiers = F.when(k % 5 == 0, F.create_map(F.lit("hot"), F.lit(10.0), F.lit("warm"), F.lit(40.0))).otherwise(F.create_map(F.lit("hot"), 50.0 + k % 7, F.lit("warm"), F.lit(40.0)))
    halves = F.when(k % 7 == 0, F.create_map(F.lit("jobs"), F.lit(0.0))).when(k % 2 == 0, F.create_map(F.lit("jobs"), F.lit(30.0)))
    params = F.to_json(F.struct(tau.alias("tau_intent"), weights.alias("weights"), tiers.alias("tiers"), halves.alias("half_life_days"), F.when(k % 2 == 1, F.lit(0.1)).alias("fit_exponent")))
    found = G.resolve_params(customers(spark, d).select("c_custkey", params.alias("params")))
    return found.select("c_custkey", "valid", "tau_intent", F.col("weights")["high"].alias("high"), "fit_exponent", F.col("half_life_days")["jobs"].alias("jobs"), F.col("tiers")["hot"].alias("hot"), "max_evidence_per_question")


@query("g29_guides", "select question_id, case when question_id % 2 = 0 then 'own' when question_id % 3 = 0 then 'category' else 'generic' end as guide from question", ("question",))
def guides(spark, d):
    m = lambda v, n=3: F.create_map(*[F.lit(x) for k in ("weak", "moderate", "strong")[:n] for x in (k, v)])
    q = view(spark, d, "question").withColumn("category", F.when(F.col("question_id") % 3 == 0, "known").otherwise("other")).withColumn("temperature", F.when(F.col("question_id") % 2 == 0, m("own")).otherwise(m("part", 1)))
    defaults = q.limit(1).select(F.lit("known").alias("category"), m("category").alias("temperature"))
    return G.temperature_guide(q, defaults, {"weak": "generic"}).select("question_id", F.col("guide")["weak"].alias("guide"))


@query("g30_outreach", "select c_custkey, case when c_custkey % 2 = 0 then 'We saw that ' || c_name || ': hires' else 'We help companies like ' || c_name || ' with speed' end as outreach from customer")
def outreach(spark, d):
    leads = customers(spark, d).select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("hires"))).otherwise(F.array().cast("array<string>")).alias("summaries"), F.array(F.lit(1)).alias("signal_ids"), F.lit("speed").alias("value_proposition"))
    return G.outreach_text(leads).select("c_custkey", "outreach")


@query("l12_rule_flags", "select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by all")
def rule_flags(spark, d):
    hits = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("name")))).alias("hits"))
    return hits.select("l_orderkey", F.array_join(L.rule_flags(F.col("hits")), ",").alias("flags"))


@query("l18_current_scores", "select c_custkey as company_id, max(o_orderkey) as score_id, case when max(o_orderkey) is null then null else 7 end as version from customer left join orders on o_custkey = c_custkey group by all")
def current_scores(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.max("o_orderkey").alias("score_id")).withColumn("is_current", F.lit(True)).withColumn("profile_id", F.lit(1))
    profiles = table(spark, d, "region").limit(1).select(F.lit(1).alias("profile_id"), F.lit(7).alias("version"))
    return L.current_score(customers(spark, d).selectExpr("c_custkey as company_id"), last, profiles).select("company_id", "score_id", "version")


@query("e04_e06_scopes", "select company_id, coalesce(industry_id in ('machinery'), false) and coalesce(employees >= 20000, false) as firm, company_id % 2 = 0 or company_id in (1, 3) as scoped from company", ("company",))
def scopes(spark, d):
    c = view(spark, d, "company")
    firm = E.firmographic_scope(F.array(F.lit("machinery")), F.lit(20000), F.lit(None).cast("long"), F.col("industry_id"), F.col("employees"))
    only = F.when(F.col("company_id") % 2 == 1, F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))
    return c.select("company_id", firm.alias("firm"), E.in_scope(only, F.col("company_id")).alias("scoped"))


@query("e06_triggers", "select signal_id, category in ('hiring', 'distress') and strength <> 'weak' as fires from signal", ("signal",))
def triggers(spark, d):
    return signals(spark, d).select("signal_id", E.triggered(F.col("category"), F.col("strength"), F.array(F.lit("hiring"), F.lit("distress")), F.lit("moderate")).alias("fires"))


@query("e10_delivery", "select rule_id, case when rule_id % 5 = 0 then 'skipped' when rule_id % 2 = 0 then 'instant' else 'queued' end as state from alert_rule", ("alert_rule",))
def delivery(spark, d):
    return view(spark, d, "alert_rule").select("rule_id", E.delivery_state(F.when(F.col("rule_id") % 2 == 0, "instant").otherwise("daily"), F.col("rule_id") % 5 != 0).alias("state"))


@query("e13_once", "select distinct signal_id % 9 as rule_id, company_id from signal except select signal_id % 9, company_id from signal where detected_at >= timestamp '2024-01-25'", ("signal",))
def once(spark, d):
    s = signals(spark, d).select((F.col("signal_id") % 9).alias("rule_id"), "company_id", F.col("detected_at").alias("notified_at"))
    return E.once_per_window(s.select("rule_id", "company_id").distinct(), s, F.lit("2024-01-25").cast("timestamp"))


@query("e16_operator_alerts", "select score_id, 'company ' || company_id || ' is hot: ' || priority || '.0' as text from (select score_id, company_id, cast(priority as bigint) as priority from score) where priority >= 65", ("score",))
def operator_alerts(spark, d):
    s = view(spark, d, "score").withColumn("tier", G.tier(F.col("priority"), F.lit(False)))
    return E.operator_alerts(s).select("score_id", "text")


@query("a01_a03_import", "select c_custkey as row, 'customer-' || lpad(cast(c_custkey as varchar), 9, '0') || '.example' as domain, c_custkey * 10 as employees from customer where c_custkey % 7 <> 0")
def import_rows(spark, d):
    dom = F.concat(F.lit("HTTPS://www."), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example/x"))
    c = customers(spark, d).select(F.col("c_custkey").alias("row"), F.col("c_name").alias("Organization Name"), F.when(F.col("c_custkey") % 7 != 0, dom).alias("Website"), F.concat(text("c_custkey"), F.lit("0+")).alias("Number of Employees"))
    return A.validate(A.map_headers(c))[0].select("row", "domain", "employees")


@query("a06_apply_resolved", "select c_custkey as company_id, case when c_custkey % 2 = 0 then 'known' else 'found' end as city, 'a.example,b.example' as own from customer")
def apply_resolved(spark, d):
    c = customers(spark, d).select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_custkey") % 2 == 0, "known").alias("city"), F.array(F.lit("b.example")).alias("own_domains"))
    r = c.select("company_id", F.lit("found").alias("city"), F.array(F.lit("a.example"), F.lit("b.example")).alias("own_domains"))
    return A.apply_resolved(c, r, ["city"]).select("company_id", "city", F.array_join("own_domains", ",").alias("own"))


@query("a09_rank_candidates", "select company_id, company_id % 2 = 0 as already_tracked from company", ("company",))
def rank_candidates(spark, d):
    c = companies(spark, d)
    return A.rank_candidates(G.fit(c, ICP, G.Profile(fit_floor=0.0)), c.where("company_id % 2 = 0")).select("company_id", "already_tracked")


@query("a12_profile_versions", "select c_nationkey as service_id, case when c_nationkey % 2 = 0 then count(*) + 1 else count(*) end as version from customer group by c_nationkey")
def profile_versions(spark, d):
    from pyspark.sql import Window

    p = customers(spark, d).select(F.col("c_nationkey").alias("service_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("bigint").alias("version"))
    p = p.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy("service_id")))
    fresh = p.where("service_id % 2 = 0").select("service_id").distinct()
    return A.new_profile_version(p, fresh).where("is_current").select("service_id", "version")


@query("a13_industry_labels", "select c_custkey, lower(c_mktsegment) as labels from customer where lower(c_mktsegment) in ('machinery', 'building')")
def industry_labels(spark, d):
    said = F.array(F.lower("c_mktsegment"), F.lit("unknown"), F.lower("c_mktsegment"))
    out = customers(spark, d).select("c_custkey", F.array_join(A.industry_labels(said, ["machinery", "building"]), ",").alias("labels"))
    return out.where("labels <> ''")


@query("s28_s13_breach_texts", "select s_suppkey, 'Breach date: 2023-05-01' || chr(10) || 'Accounts: ' || s_suppkey as text from supplier")
def breach_texts(spark, d):
    sup = table(spark, d, "supplier")
    b = F.struct(F.concat(F.lit("B"), text("s_suppkey")).alias("Name"), F.concat(F.lit("B"), text("s_suppkey")).alias("Title"), F.concat(F.lit("s"), text("s_suppkey"), F.lit(".example")).alias("Domain"), F.lit("2023-05-01").alias("BreachDate"), F.lit("2023-06-01T00:00:00Z").alias("AddedDate"), F.col("s_suppkey").alias("PwnCount"))
    own = sup.select(F.col("s_suppkey").alias("company_id"), F.concat(F.lit("s"), text("s_suppkey"), F.lit(".example")).alias("domain"), F.lit(None).cast("array<string>").alias("own_domains"))
    return S.incident_docs(sup.select(F.to_json(F.array(b)).alias("raw")), own, F.lit("2023-01-01").cast("timestamp")).select(F.col("company_id").alias("s_suppkey"), "text")


@query("d03_snippets", "select doc_id, count(*) as n from document, range(2) where source_type in ('news', 'jobs') and published_on >= date '2024-01-10' group by all", ("document",))
def snippets(spark, d):
    docs = view(spark, d, "document")
    chunks = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    return D.snippets(chunks, docs.withColumn("fetched_on", F.lit(None).cast("date")), F.lit("2024-01-10").cast("date"), ["news", "jobs"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("l03_any_trend", "select distinct company_id, service_id from signal where status = 'active' and category <> 'tech_stack' and strength = 'strong'", ("signal",))
def any_trend(spark, d):
    pairs = signals(spark, d).select("company_id", "service_id").distinct()
    return L.with_trend(pairs, signals(spark, d), None, "strong")
