"""Text, web, retrieval and verification queries over the driver's documents and pages, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as LM
from ..functions import text as T
from ..operators import clusters as C
from ..operators import dedup as D
from ..operators import impact as I
from ..operators import retrieval as R
from ..operators import verify as V
from ..sources import landing as S
from ..sources import web as W
from .demo import view, with_views
from .scoring_queries import now, r6, rounded, rounded_binary, signals

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: tuple = ()):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return f

    return put


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").withColumn("company_id", F.col("page_id") % 50)


# Text ----------------------------------------------------------------------------------------------------------
CANON = """regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')
  || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(lower(p), 'utm_') and split_part(lower(p), '=', 1) not in ('gclid', 'fbclid', 'mc_cid', 'mc_eid')), '&'), ''), '')"""


@query("c01_canonical_url", f"select page_id, {CANON} as url from pages")
def canonical_url(spark, d):
    return pages(spark, d).select("page_id", T.canonical_url(F.col("url")).alias("url"))


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query("c02_clean_text", f"with l as (select doc_id, {LINES} as l from documents) select doc_id, md5(rtrim(left(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), chr(10)), 50000))) as digest from l")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query("c03_content_hash", "select doc_id, sha256(replace(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')) as content_hash from documents")
def content_hash(spark, d):
    return documents(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("c04_c24_titles", "select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) as title from documents")
def titles(spark, d):
    return documents(spark, d).select("doc_id", T.clean_title(F.col("text")).alias("title"))


@query("c06_language", "with w as (select doc_id, text, list_filter(regexp_split_to_array(lower(left(text, 400)), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as w from documents), v as (select doc_id, text, [{" + "}, {".join(f"'n': len(list_filter(w, lambda x: list_contains({ws!r}, x))), 'i': {-i}, 'k': '{k}'" for i, (k, ws) in enumerate(T.LANGUAGE_WORDS.items())) + "}] as v from w) select doc_id, case when length(trim(text)) >= 40 and list_sort(v, 'desc')[1].n > 0 then list_sort(v, 'desc')[1].k end as language from v")
def language(spark, d):
    return documents(spark, d).select("doc_id", T.guess_language(F.col("text")).alias("language"))


@query("c08_c09_hosts", "select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as domain from pages")
def hosts(spark, d):
    return pages(spark, d).select("page_id", T.host(F.col("url")).alias("host"), T.normalize_domain(F.col("url")).alias("domain"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
FOLD = "strip_accents(replace(replace(replace(lower(text), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"
TOKENS = f"list_filter(regexp_extract_all({FOLD}, '[a-z0-9]+'), lambda w: not list_contains({STOP}, w))"


@query("c10_c11_tokens", f"select doc_id, len({TOKENS}) as n, md5(array_to_string({TOKENS}, ' ')) as digest from documents")
def tokens(spark, d):
    t = T.tokenize(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("c13_evidence_keys", "select signal_id, sha256('q' || question_id || chr(10) || lower(quote) || chr(10)) as evidence_key from signal", ("signal",))
def evidence_keys(spark, d):
    return signals(spark, d).select("signal_id", T.evidence_key(F.concat(F.lit("q"), F.col("question_id").cast("string")), F.col("quote"), F.lit(None).cast("string")).alias("evidence_key"))


@query("c15_source_key", "select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') || rtrim(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as source_key from pages")
def source_key(spark, d):
    return pages(spark, d).select("page_id", T.source_key(F.col("url"), F.col("page_id")).alias("source_key"))


@query("c16_numbers", "select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') as digits from (select doc_id, regexp_replace(text, '[.,]', ' ', 'g') as text from documents)")
def numbers(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(F.array_sort(T.numbers(F.translate("text", ".,", "  "))), ",").alias("digits"))


@query("c17_token_estimate", "select source, cast(sum(length(text) // 4) as bigint) as tokens from documents group by all")
def token_estimate(spark, d):
    return documents(spark, d).groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query("c19_name_keys", "select s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) as name_key from supplier")
def name_keys(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", T.name_key(F.concat(F.lit("The "), "s_name", F.lit(" Holding AG"))).alias("name_key"))


@query("c21_amounts", "select o_orderkey, cast(round(o_totalprice * 1000000, 2) as decimal(38, 2)) as amount from orders where o_orderkey % 7 = 0")
def amounts(spark, d):
    said = F.concat(F.lit("EUR "), F.format_string("%.2f", "o_totalprice"), F.lit(" million"))
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 7 = 0").select("o_orderkey", T.amount(said).alias("amount"))


@query("c07_c26_index_text", "select doc_id, case when source_type in ('news', 'jobs') then length('Title ' || doc_id || chr(10)) else 0 end + length(text) as n from document", ("document",))
def index_text(spark, d):
    docs = view(spark, d, "document")
    title = F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.length(T.index_text(title, F.col("text"), F.col("source_type"))).cast("bigint").alias("n"))


FOLDED = """+ recursive_docs as (select doc_id, source_name as g, 'u' || doc_id % 700 as u, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as h, row_number() over (partition by source_name order by doc_id) as n from document),
fold(g, n, doc_id, keep, us, hs) as (
  select g, n, doc_id, true, [u], [h] from recursive_docs where n = 1
  union all
  select d.g, d.n, d.doc_id, fresh, case when fresh then list_append(us, d.u) else us end, case when fresh then list_append(hs, d.h) else hs end
  from (select d.*, us, hs, not (list_contains(us, d.u) or list_contains(hs, d.h)) as fresh from fold f join recursive_docs d on d.g is not distinct from f.g and d.n = f.n + 1) d)
select doc_id from fold where keep"""


@query("d01_collection_dedup", with_views(FOLDED, "document").replace("with ", "with recursive ", 1))
def collection_dedup(spark, d):
    docs = view(spark, d, "document").select("doc_id", F.col("source_name").alias("company_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("canonical_url"), T.content_hash(F.col("text")).alias("content_hash"))
    return D.collection_dedup(docs).select("doc_id")


@query("d10_extraction_batches")
def extraction_batches(spark, d):
    q = signals(spark, d).select("company_id", "service_id", F.col("signal_id").alias("ord"), (F.length("quote") * 100).alias("tokens"))
    return D.extraction_batches(q, 8000)


# Web -----------------------------------------------------------------------------------------------------------
@query("s18_c27_page_documents")
def page_documents(spark, d):
    return W.page_documents(pages(spark, d)).select("company_id", "url", "title", "content_hash")


SEG = "list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '')"
HREF = "unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\">', 1))"


@query("s26_links", "with l as (select page_id % 50 as company_id, url as page_url, " + HREF + " as h from pages) select company_id, page_url, count(*) as n from l group by all")
def page_links(spark, d):
    return W.links(pages(spark, d)).groupBy("company_id", "page_url").agg(F.count("*").alias("n"))


@query("s19_page_kinds", f"select page_id, case when list_has_any({SEG}, ['news', 'media']) then 'news' when list_has_any({SEG}, ['ir']) then 'ir' else 'other' end as kind from pages")
def page_kinds(spark, d):
    return pages(spark, d).select("page_id", W.page_kind(F.col("url")).alias("kind"))


@query("s20_one_per_locale", f"""with p as (select page_id % 50 as company_id, url, {SEG} as s from pages), k as (select *, array_to_string(list_filter(s, lambda x: not regexp_matches(x, '^[a-z]{{2}}([-_][a-z]{{2}})?$')), '/') as key, list_filter(s, lambda x: regexp_matches(x, '^[a-z]{{2}}([-_][a-z]{{2}})?$'))[1] as loc from p)
select company_id, key, url from k qualify row_number() over (partition by company_id, key order by case when loc is null then 0 when starts_with(loc, 'en') then 1 else 2 end, length(url), url) = 1""")  # fmt: skip
def one_per_locale(spark, d):
    seg = W.path_segments(F.col("url"))
    out = W.one_per_locale(pages(spark, d).withColumn("domain", F.lit("none.example")).select("company_id", "url", "domain").distinct())
    return out.select("company_id", F.array_join(F.filter(seg, lambda s: ~s.rlike(W.LOCALE)), "/").alias("key"), "url")


@query("s21_select_pages", """with p as (select page_id % 50 as company_id, url, case page_id % 3 when 0 then 'news' when 1 then 'ir' else 'careers' end as kind, page_id % 40 as age from pages),
i as (select *, row_number() over (partition by company_id, kind order by age desc nulls last, len(list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda s: s <> '')), url) as n from p)
select company_id, url, cast(row_number() over (partition by company_id order by n, case kind when 'news' then 1 when 'ir' then 3 else 5 end, url) as int) as nth from i qualify nth <= 12""")  # fmt: skip
def select_pages(spark, d):
    p = pages(spark, d).withColumn("kind", F.when(F.col("page_id") % 3 == 0, "news").when(F.col("page_id") % 3 == 1, "ir").otherwise("careers")).withColumn("lastmod", F.col("page_id") % 40)
    return W.select_pages(p, 12).select("company_id", "url", "nth")


#: The table's links are rooted; here those of every page lie below it, as on a page that lists articles.
BELOW = "with l as (select page_id % 50 as company_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, unnest(regexp_extract_all(html, '<a href=\"/([^\"#]+)\">', 1)) as h from pages)"


@query("s22_article_links", BELOW + " select company_id, count(*) as n from l where not regexp_matches(lower(path || '/' || h), '[?&/](page|seite|p)[=/][0-9]+') group by all")
def article_links(spark, d):
    p = pages(spark, d)
    below = p.withColumn("html", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), F.rtrim(T.url_part(F.col("url"), "PATH"), F.lit("/")), F.lit("/"))))
    return W.article_links(below).groupBy("company_id").agg(F.count("*").alias("n"))


@query("s11_careers_links")
def careers_links(spark, d):
    return W.careers_links(pages(spark, d).withColumn("html", F.regexp_replace("html", 'href="/', 'href="/jobs/')), least=3).select("company_id", "canonical_url", "title", "headline_only")


@query("s25_detect_ats", """select page_id % 50 as company_id, url, case page_id % 4 when 0 then 'greenhouse' when 1 then 'workday' else 'lever' end as ats, 'acme' || page_id % 9 as token,
  case page_id % 4 when 1 then 'acme' || page_id % 9 || '.wd3.myworkdayjobs.com' when 2 then 'jobs.eu.lever.co' end as host, case page_id % 4 when 1 then 'careers' end as site from pages where page_id % 4 <> 3""")
def detect_ats(spark, d):
    token = F.concat(F.lit("acme"), (F.col("page_id") % 9).cast("string"))
    board = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<iframe src="https://boards.greenhouse.io/embed/job_board?for='), token, F.lit('">')))
    board = board.when(F.col("page_id") % 4 == 1, F.concat(F.lit('<a href="https://'), token, F.lit('.wd3.myworkdayjobs.com/en-us/careers">'))).when(F.col("page_id") % 4 == 2, F.concat(F.lit('<a href="https://jobs.eu.lever.co/'), token, F.lit('">')))
    return W.detect_ats(pages(spark, d).withColumn("html", F.concat("html", F.coalesce(board, F.lit("")))))


@query("s23_rank_report_links", """with l as (select c_custkey % 40 as company_id, 'https://x.example/' || case c_custkey % 4 when 0 then 'annual-report-' when 1 then 'privacy-report-' when 2 then 'bericht-' else 'files-' end || (2019 + c_custkey % 6) || '-' || c_custkey % 9 || '.pdf' as url from customer),
s as (select distinct company_id, url, cast(regexp_extract(url, '20[0-9]{2}') as int) as year, case when url like '%annual-report%' then 6 when url like '%bericht%' then 1 else 0 end as points from l where url not like '%privacy%')
select company_id, url, points + 2 * (year - 2022) as score from s where points > 0 and year >= 2022 qualify row_number() over (partition by company_id order by score desc, url) <= 5""")  # fmt: skip
def rank_report_links(spark, d):
    kind = F.when(F.col("c_custkey") % 4 == 0, "annual-report-").when(F.col("c_custkey") % 4 == 1, "privacy-report-").when(F.col("c_custkey") % 4 == 2, "bericht-").otherwise("files-")
    url = F.concat(F.lit("https://x.example/"), kind, (2019 + F.col("c_custkey") % 6).cast("string"), F.lit("-"), (F.col("c_custkey") % 9).cast("string"), F.lit(".pdf"))
    found = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 40).alias("company_id"), url.alias("url"), F.lit("").alias("label"))
    return W.rank_report_links(found, 2024).select("company_id", "url", F.col("score").cast("bigint").alias("score"))


@query("s24_report_pages")
def report_pages(spark, d):
    rows = documents(spark, d).select((F.col("doc_id") % 60).alias("doc_id"), F.floor(F.col("doc_id") / 60).cast("int").alias("page"), "text")
    return W.select_report_pages(rows, ["strategy", "license", "public", "risk"]).select("doc_id", "page", "hits")


@query("s01_documents")
def landed_documents(spark, d):
    raw = documents(spark, d).select((F.col("doc_id") % 150).alias("company_id"), F.concat(F.lit("HTTPS://Example.com/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x")).alias("url"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("body"), F.lit("2024-01-05").alias("date"))
    return S.to_documents(raw, "news", "landing").select("company_id", "canonical_url", "content_hash", "language", "published_at")


@query("s02_news_articles")
def news_articles(spark, d):
    """Article lists made of the pages' addresses."""
    art = F.struct(F.col("url"), F.concat(F.lit("News "), F.col("page_id").cast("string")).alias("title"), F.date_format(F.expr("timestamp '2024-01-01' + make_dt_interval(cast(page_id % 25 as int))"), "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.lit("English").alias("language"))
    raw = pages(spark, d).groupBy("company_id").agg(F.to_json(F.struct(F.collect_list(art).alias("articles"))).alias("raw"))
    return S.news_articles(raw, F.lit("2024-01-08").cast("timestamp")).select("company_id", "canonical_url", "title", "published_at", "headline_only")


@query("s12_incidents")
def incidents(spark, d):
    """Breaches of suppliers' hosts met with companies by domain suffixes."""
    host = F.concat(F.lit("mail.customer-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".example"))
    b = F.struct(F.col("s_name").alias("Name"), F.col("s_name").alias("Title"), host.alias("Domain"), F.lit("2023-05-01").alias("BreachDate"), F.lit("2023-06-01T00:00:00Z").alias("AddedDate"), F.col("s_suppkey").alias("PwnCount"), F.lit("<p>Leak</p>").alias("Description"), (F.col("s_suppkey") % 5 == 0).alias("IsFabricated"))
    raw = spark.read.parquet(f"{d}/supplier.parquet").select(F.to_json(F.array(b)).alias("raw"))
    own = view(spark, d, "company").withColumn("own_domains", F.lit(None).cast("array<string>"))
    return S.incident_docs(raw, own, F.lit("2023-01-01").cast("timestamp")).select("company_id", "title", "text")


@query("s15_legal_entities", "select c_custkey as company_id, 'L' || c_custkey as lei from customer where c_custkey % 3 = 0")
def legal_entities(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    live = c.where("c_custkey % 3 < 2").select(F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("lei"), F.concat("c_name", F.lit(" GmbH")).alias("legal_name"), F.lit("ACTIVE").alias("status"), F.lit("ISSUED").alias("registration"))
    twin = c.where("c_custkey % 3 = 1").select(F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("lei"), F.upper("c_name").alias("legal_name"), F.lit("ACTIVE").alias("status"), F.lit("ISSUED").alias("registration"))
    return S.match_legal_entity(c.selectExpr("c_custkey as company_id", "c_name as name"), live.unionByName(twin)).select("company_id", "lei")


# Retrieval -----------------------------------------------------------------------------------------------------
def chunks(spark, d):
    docs = view(spark, d, "document")
    return R.chunk_documents(docs.select("doc_id", "text")).join(docs.select("doc_id", "company_id", "source_type", "published_on"), "doc_id").withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("ord"))


@query("r01_sentences")
def sentence_rows(spark, d):
    return R.sentences(documents(spark, d)).select("doc_id", "nth", "start", F.length("text").alias("length"))


@query("r02_split_long", "select doc_id, greatest(1, cast(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 220.0) as int)) as parts from documents")
def split_long(spark, d):
    return documents(spark, d).select("doc_id", F.size(R.split_long(F.col("text"))).alias("parts"))


@query("r03_chunks")
def chunk_rows(spark, d):
    return chunks(spark, d).select("doc_id", "ord", "char_start", "char_end")


@query("r08_contexts")
def context_rows(spark, d):
    return R.contexts(chunks(spark, d)).select("doc_id", "ord", F.length("context").alias("length"))


def queries_of(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


BM = f"""with qs as (select item_id as question_id, unnest(list_distinct({TOKENS})) as term from benchmark),
w as (select source, doc_id as chunk_id, {TOKENS} as w from documents),
st as (select source, count(*) as n, avg(len(w)) as al from w group by all),
tf as (select source, chunk_id, len, term, count(*) as tf from (select source, chunk_id, len(w) as len, unnest(w) as term from w) where term in (select term from qs) group by all),
df as (select source, term, count(*) as df from tf group by all),
g as (select tf.source, chunk_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) as gain from tf join df using (source, term) join st using (source)),
bm as (select source, chunk_id, question_id, sum(gain) as bm25 from g join qs using (term) group by all)
"""


def bm(spark, d):
    docs = documents(spark, d).select("source", F.col("doc_id").alias("chunk_id"), "text")
    return R.bm25(docs, queries_of(spark, d), ["source"])


@query("r05_bm25", BM + "select source, chunk_id, question_id, round(bm25, 6) as bm25 from bm")
def bm25(spark, d):
    return bm(spark, d).select("source", "chunk_id", "question_id", *r6("bm25"))


COS = "(select v.vec_id as chunk_id, q.vec_id as question_id, list_cosine_similarity(list_transform(v.embedding, lambda x: cast(x as double)), list_transform(q.embedding, lambda x: cast(x as double))) as cos from embeddings v, embeddings q where q.vec_id % 20 = 0)"


def cosines(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return I.cosine_all(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), q)  # the stated set of questions against all rows


@query("r06_cosine", f"select chunk_id, question_id, round(cos, 6) as cos from {COS}")
def cosine(spark, d):
    return cosines(spark, d).select("chunk_id", "question_id", rounded_binary(F.col("cos")).alias("cos"))


#: Companies of the demo: every fifth text and vector is one's. Counts and ranks are a company's own.
COMPANIES = 5
BMC = BM.replace("select source, doc_id as chunk_id", f"select doc_id % {COMPANIES} as company_id, doc_id as chunk_id").replace("source", "company_id")
COSC = f"(select * from {COS} where true)".replace("select v.vec_id as chunk_id", f"select v.vec_id % {COMPANIES} as company_id, v.vec_id as chunk_id")
FUSED = BMC.rstrip() + f""", c as {COSC}, s as (select coalesce(bm.company_id, c.company_id) as company_id, coalesce(bm.question_id, c.question_id) as question_id, coalesce(bm.chunk_id, c.chunk_id) as chunk_id, bm25, cos from bm full join c on bm.company_id = c.company_id and bm.chunk_id = c.chunk_id and bm.question_id = c.question_id),
rk as (select *, row_number() over (partition by company_id, question_id order by round(bm25, 9) desc nulls last, chunk_id) as rb, row_number() over (partition by company_id, question_id order by round(cos, 9) desc nulls last, chunk_id) as rc from s),
f as (select company_id, question_id, chunk_id, case when bm25 > 0 and rb <= 20 then 1.0 / (60 + rb) else 0 end + case when cos is not null and rc <= 20 then 1.0 / (60 + rc) else 0 end as rrf from rk where ((bm25 > 0 and rb <= 20) or (cos is not null and rc <= 20)) and (coalesce(bm25, 0) > 0 or cos >= 0.78))
"""


def company_chunks(spark, d):
    return documents(spark, d).select((F.col("doc_id") % COMPANIES).alias("company_id"), F.col("doc_id").alias("chunk_id"), "text")


@query("r05_bm25_top", BMC + "select company_id, question_id, chunk_id, cast(row_number() over (partition by company_id, question_id order by round(bm25, 9) desc, chunk_id) as int) as rank, round(bm25, 6) as bm25 from bm qualify rank <= 20")
def bm25_top(spark, d):
    found = I.bm25_top(I.postings(company_chunks(spark, d), queries_of(spark, d), ["company_id"]), queries_of(spark, d), ["company_id"])
    return found.select("company_id", "question_id", "chunk_id", "rank", *r6("bm25"))


@query("r06_cosine_top", f"select company_id, question_id, chunk_id, cast(row_number() over (partition by company_id, question_id order by round(cos, 9) desc, chunk_id) as int) as rank, round(cos, 6) as cos from {COSC} qualify rank <= 20")
def cosine_top(spark, d):
    return best_cosines(spark, d).select("company_id", "question_id", "chunk_id", "rank", *r6("cos"))


def best_cosines(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return I.cosine_top(e.select((F.col("vec_id") % COMPANIES).alias("company_id"), F.col("vec_id").alias("chunk_id"), "embedding"), q, ["company_id"])


def fused(spark, d):
    by, questions = ["company_id"], queries_of(spark, d)
    index = I.postings(company_chunks(spark, d), questions, by)
    return I.fused(I.bm25_top(index, questions, by), best_cosines(spark, d), index, questions, by)


@query("r12_rank_fusion", FUSED + "select company_id, question_id, chunk_id, round(rrf, 6) as rrf from f")
def rank_fusion(spark, d):
    return fused(spark, d).select("company_id", "question_id", "chunk_id", *r6("rrf"))


@query("r13_top_diverse", FUSED + ", a as (select *, chunk_id % 7 as doc_id, row_number() over (partition by company_id, question_id, chunk_id % 7 order by rrf desc, chunk_id) as dn from f) select company_id, question_id, chunk_id, cast(row_number() over (partition by company_id, question_id order by rrf desc, chunk_id) as int) as nth from a where dn <= 2 qualify nth <= 5")
def top_diverse(spark, d):
    return R.top_diverse(fused(spark, d).withColumn("doc_id", F.col("chunk_id") % 7), ["company_id"]).select("company_id", "question_id", "chunk_id", "nth")


@query("r14_r15_budget")
def budget(spark, d):
    chosen = R.top_diverse(fused(spark, d).withColumn("doc_id", F.col("chunk_id") % 7), ["company_id"]).withColumn("weight", F.lit("high"))
    tokens = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))
    kept = R.apply_budget(chosen.join(tokens, "chunk_id"), ["company_id"], most=15, tokens=9000)
    return R.label_snippets(kept.withColumn("source_type", F.lit("news")).withColumn("doc_id", F.col("chunk_id") % 7).withColumn("char_start", F.lit(0)), ["company_id"]).select("company_id", "chunk_id", "guarded")


@query("r11_d03_question_pool", """+ q(question_id, source_type, days, neg) as (values (1, 'news', 20, 'license'), (2, 'jobs', 40, 'zzz'))
select doc_id, question_id from document join q using (source_type) where published_on >= date '2024-01-31' - days and not contains(lower(text), neg)""", ("document",))  # fmt: skip
def question_pool(spark, d):
    q = spark.createDataFrame([(1, ["news"], 20, ["license"]), (2, ["jobs"], 40, ["zzz"])], "question_id int, source_types array<string>, recency_days int, negative_terms array<string>")
    return R.question_pool(view(spark, d, "document").withColumn("seen_on", F.col("published_on")), q, now()).select("doc_id", "question_id")


@query("r09_r10_entity_filter")
def entity_filter(spark, d):
    docs = view(spark, d, "document").withColumn("title", F.lit(""))
    names = documents(spark, d).groupBy((F.col("doc_id") % 150).alias("company_id")).agg(F.array(F.min(F.initcap(F.try_element_at(F.split("text", " "), F.lit(2))))).alias("names")).withColumn("homonyms", F.array().cast("array<string>")).withColumn("domains", F.array().cast("array<string>"))
    return R.entity_filter(docs, names).select("doc_id", "company_id")


@query("r16_resolve_answers", "select doc_id, case when doc_id % 4 = 0 then 'no' when doc_id % 5 = 0 then 'unclear' else coalesce(case when quality is null then null when quality = 1 then 'yes' else 'no' end, 'unclear') end as answer from documents left join labels using (doc_id)")
def resolve_answers(spark, d):
    pairs = documents(spark, d).select("doc_id", F.lit(1).alias("question_id"), (F.col("doc_id") % 4 != 0).alias("has_candidates"), (F.col("doc_id") % 5 == 0).alias("blocked"))
    answers = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(1).alias("question_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"))
    return R.resolve_answers(pairs, answers, ["doc_id"]).select("doc_id", "answer")


# Verification --------------------------------------------------------------------------------------------------
def evidence(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("quote"))
    docs = documents(spark, d).select("doc_id", "text", (F.col("doc_id") % b.count()).alias("item_id"), F.lit("").alias("title"))
    own = F.when(F.col("doc_id") % 3 == 0, F.upper(F.substring("text", 40, 90))).when(F.col("doc_id") % 3 == 1, F.concat(F.substring("text", 10, 60), F.lit("x"), F.substring("text", 71, 30))).otherwise(F.col("quote"))
    return docs.join(F.broadcast(b), "item_id").withColumn("quote", own)


@query("v02_v03_quotes")
def quotes(spark, d):
    return V.locate_quotes(evidence(spark, d)).select("doc_id", "found", "quote_start", "quote_end")


V_SQL = """+ e as (select *, case when event_date is not null then least(event_date, date '2024-01-25') else cast(detected_at as date) end as date, round_even(confidence * case when signal_id % 4 = 0 then 0.9 else 1.0 end, 4) as c from signal)
select signal_id, case when signal_id % 10 = 3 then 'quote_not_found' when signal_id % 7 = 2 then 'wrong_subject' when date '2024-01-25' - date > 14 then 'stale' when c < 0.5 then 'below_confidence' end as reason from e"""


@query("v05_v07_reject_reasons", V_SQL, ("signal",))
def reject_reasons(spark, d):
    s = signals(spark, d)
    today = F.lit("2024-01-25").cast("date")
    date, _ = V.event_date(F.when(F.col("event_date") <= today, F.col("event_date")), F.when(F.col("event_date") > today, today), F.col("detected_at"), today)
    found = F.when(F.col("signal_id") % 10 == 3, None).when(F.col("signal_id") % 4 == 0, "fuzzy").otherwise("exact")
    how = F.when(F.col("signal_id") % 4 == 0, "fuzzy").otherwise("exact")
    return s.select("signal_id", V.reject_reason(found, F.col("signal_id") % 7 != 2, date, today, F.lit(14), V.confidence(F.col("confidence"), how)).alias("reason"))


@query("v08_distinct_evidence", "select count(*) as n from (select distinct question_id, document_id, signal_id % 3, quote from signal)", ("signal",))
def distinct_evidence(spark, d):
    s = signals(spark, d).withColumn("quote_start", (F.col("signal_id") % 3).cast("int")).withColumn("quote_end", F.col("quote_start") + 10)
    return V.distinct_evidence(s).agg(F.count("*").alias("n"))


@query("v10_final_answers", "select doc_id, case when quality = 1 and doc_id % 3 <> 0 then 'unclear' when quality = 1 then 'yes' else 'no' end as answer, case when quality = 1 and doc_id % 3 <> 0 and doc_id % 2 = 0 then 'no_evidence_for_yes' end as reason from labels")
def final_answers(spark, d):
    t = spark.read.parquet(f"{d}/labels.parquet")
    answers = t.select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"), (F.col("doc_id") % 2).alias("n_evidence"))
    return V.final_answer(answers, t.where("doc_id % 3 = 0"), ["doc_id"]).select("doc_id", "answer", "reason")


EVENT_KEYS = ["company_id", "service_id", "question_id"]


def dated(spark, d):
    return signals(spark, d).where("status = 'active'").withColumn("date", F.col("event_date")).withColumn("summary", F.lit(None).cast("string"))


PAIRS = "+ s as (select * from signal where status = 'active'), p as (select a.company_id, a.service_id, a.question_id, a.signal_id as a, b.signal_id as b from s a join s b using (company_id, service_id, question_id) where a.signal_id < b.signal_id and (a.event_date is null or b.event_date is null or abs(a.event_date - b.event_date) <= 14) and a.quote[7:] [:3] is not null and regexp_extract(a.quote, '[0-9]+') = regexp_extract(b.quote, '[0-9]+'))\n"


@query("k01_k02_candidate_pairs", PAIRS + "select a, b from p", ("signal",))
def candidate_pairs(spark, d):
    pairs = V.candidate_pairs(dated(spark, d), EVENT_KEYS)
    return pairs.select(F.least("a_signal_id", "b_signal_id").alias("a"), F.greatest("a_signal_id", "b_signal_id").alias("b"))


CLUSTERS = """+ s as (select * from signal where status = 'active'),
stepped as (select *, bool_or(event_date is null) over g as loose, lag(event_date) over (partition by company_id, service_id, question_id, quote order by event_date, signal_id) as before
  from s window g as (partition by company_id, service_id, question_id, quote)),
islands as (select *, case when loose then 0 else sum(case when event_date - before > 14 then 1 else 0 end) over (partition by company_id, service_id, question_id, quote order by event_date, signal_id rows unbounded preceding) end as island from stepped),
named as (select *, min(signal_id) over (partition by company_id, service_id, question_id, quote, island) as cluster from islands),
per_source as (select company_id, service_id, question_id, cluster, source_type, max(cast(confidence as double)) as c from named group by all),
sure as (select company_id, service_id, question_id, cluster, case when count(*) > 1 then greatest(max(c), least(0.98, 1 - product(1 - c))) else max(c) end as confidence, count(*) as sources from per_source group by all),
led as (select company_id, service_id, question_id, cluster, arg_max(signal_id, (cast(confidence as double), -signal_id)) as lead, count(*) as n from named group by all)
select company_id, service_id, question_id, cluster, round(confidence, 6) as confidence, sources, lead, n from led join sure using (company_id, service_id, question_id, cluster)"""


@query("k03_k06_clusters", CLUSTERS, ("signal",))
def clusters(spark, d):
    members = C.event_clusters(dated(spark, d).drop("document_id"), EVENT_KEYS).withColumn("source_key", F.col("source_type")).withColumn("confidence", F.col("confidence").cast("double")).withColumn("value", F.col("confidence"))
    return V.cluster_leads(members, EVENT_KEYS).select(*EVENT_KEYS, "cluster", rounded(F.col("confidence")).alias("confidence"), "sources", "lead", "n")


@query("c06_language_model")
def language_model(spark, d):
    docs = documents(spark, d)
    model = LM.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return LM.with_language(docs, model).select("doc_id", "language")
