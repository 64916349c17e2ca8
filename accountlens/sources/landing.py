"""Landed payloads to one schema of documents: news, jobs, registries, incidents.

A payload is a row with company_id and raw (JSON or XML text). Every function keeps
one row a document and stays in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT = ["company_id", "source_type", "source_name", "url", "canonical_url", "title", "text", "published_at", "language", "content_hash", "headline_only"]


def to_documents(raw: DataFrame, source_type: str, source_name: str, max_chars: int = 50_000, cleaned: bool = False) -> DataFrame:
    """Rows with company_id, url, title, body, date (text or timestamp) as documents. A missing body is the title's. cleaned: bodies have their lines cleaned."""
    title = T.clean_title(F.col("title"))
    whole = F.coalesce("body", F.lit(""))
    body = F.regexp_replace(F.left(whole, F.lit(max_chars)), r"(?U)\s+$", "") if cleaned else T.clean_text(whole, max_chars)
    date = F.col("date") if dict(raw.dtypes)["date"] == "timestamp" else T.utc_datetime(F.col("date"))
    out = raw.withColumn("_body", body).withColumn("title", title).withColumn("text", F.when(F.col("_body") != "", F.col("_body")).otherwise(F.col("title")))
    language = F.coalesce(F.col("language"), T.guess_language(F.col("text"))) if "language" in raw.columns else T.guess_language(F.col("text"))
    return out.select(
        "company_id", F.lit(source_type).alias("source_type"), F.lit(source_name).alias("source_name"), "url", T.canonical_url(F.col("url")).alias("canonical_url"), "title", "text",
        date.alias("published_at"), language.alias("language"), T.content_hash(F.col("text")).alias("content_hash"), (F.col("_body") == "").alias("headline_only"),
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def most(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """At most n rows a company."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("company_id").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


# Language names of article lists.
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "dutch": "nl", "italian": "it"}


def news_articles(raw: DataFrame, since: Column, n: int = 20) -> DataFrame:
    """An article list; the newest first, one a canonical URL, none older than ``since``."""
    kind = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"
    rows = raw.select("company_id", F.explode(F.from_json("raw", kind)["articles"]).alias("a")).select("company_id", "a.*")
    code = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        code = F.when(F.lower("language") == k, v).otherwise(code)
    rows = rows.withColumn("date", F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))).where(F.col("date") >= since)
    docs = to_documents(rows.withColumn("language", code).withColumn("body", F.lit(None).cast("string")), "news", "article_list")
    order = [F.desc("published_at"), F.col("url").asc()]
    return most(first_by(docs, ["company_id", "canonical_url"], order), n, order)


def rss_items(raw: DataFrame) -> DataFrame:
    """(company_id, position, title, url, body, date, source) of RSS 2.0 items."""
    item = "struct<title:string,link:string,description:string,pubDate:string,source:string>"
    rows = raw.select("company_id", F.posexplode(F.from_xml("raw", f"channel struct<item:array<{item}>>")["channel"]["item"]).alias("position", "i"))
    return rows.select("company_id", "position", F.col("i.title").alias("title"), F.col("i.link").alias("url"), T.html_text(F.col("i.description"), escaped=True).alias("body"), F.col("i.pubDate").alias("date"), F.col("i.source").alias("source"))


def rss_news(items: DataFrame, n: int = 20) -> DataFrame:
    """Titles without " - publisher", no body that repeats the title, one a title across queries."""
    tail = F.concat(F.lit(" - "), F.col("source"))
    bare = F.when(F.col("title").endswith(tail), F.expr("left(title, length(title) - length(source) - 3)")).otherwise(F.col("title"))
    rows = items.withColumn("title", bare).withColumn("body", F.when(F.lower(F.trim("body")).startswith(F.lower("title")), None).otherwise(F.col("body")))
    one = first_by(rows.withColumn("_key", F.lower("title")), ["company_id", "_key"], [F.col("position").asc(), F.col("url").asc()])
    docs = to_documents(one, "news", "rss_news")
    return most(docs, n, [F.desc("published_at"), F.col("url").asc()])


def rss_feed(items: DataFrame) -> DataFrame:
    """Title and link are needed; one a link; a missing date stays missing."""
    whole = items.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("url"), F.lit("")) != ""))
    return to_documents(first_by(whole, ["company_id", "url"], [F.col("position").asc()]), "news", "rss_feed")


def newsapi_articles(raw: DataFrame) -> DataFrame:
    """No removed articles; the mark of truncation goes; without a body headline only."""
    kind = "articles array<struct<title:string,url:string,description:string,content:string,publishedAt:string>>"
    rows = raw.select("company_id", F.explode(F.from_json("raw", kind)["articles"]).alias("a")).select("company_id", "a.*").where(F.coalesce("title", F.lit("")) != "[Removed]")
    body = F.regexp_replace(F.coalesce("content", "description"), r"\s*(…|\.\.\.)?\s*\[\+\d+ chars\]\s*$", "")
    return to_documents(rows.select("company_id", "url", "title", body.alias("body"), F.col("publishedAt").alias("date")), "news", "news_api")


def search_results(raw: DataFrame, since: Column) -> DataFrame:
    """News results, else organic ones; one a link; undated ones stay."""
    item = "struct<title:string,link:string,snippet:string,date:string>"
    parsed = F.from_json("raw", f"news_results array<{item}>, organic_results array<{item}>")
    rows = raw.select("company_id", F.posexplode_outer(F.coalesce(parsed["news_results"], parsed["organic_results"])).alias("position", "i")).where("i is not null")
    rows = rows.select("company_id", "position", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.col("i.snippet").alias("body"), F.col("i.date").alias("date"))
    docs = to_documents(first_by(rows, ["company_id", "url"], [F.col("position").asc()]), "news", "search")
    return docs.where(F.col("published_at").isNull() | (F.col("published_at") >= since))


#: Of each job board the schema of its payload, the array of postings, and (title, body, url, date, facts) of a posting p.
JOB_BOARDS = {
    "greenhouse": (
        "jobs array<struct<title:string,content:string,absolute_url:string,updated_at:string,first_published:string,location:struct<name:string>,departments:array<struct<name:string>>>>", "jobs",
        lambda p: (p["title"], T.html_text(p["content"], escaped=True), p["absolute_url"], F.coalesce(p["first_published"], p["updated_at"]), [F.try_element_at(p["departments"], F.lit(1))["name"], p["location"]["name"]]),
    ),
    "lever": (
        "array<struct<text:string,descriptionPlain:string,hostedUrl:string,applyUrl:string,createdAt:bigint,categories:struct<location:string,team:string,commitment:string>>>", None,
        lambda p: (p["text"], p["descriptionPlain"], F.coalesce(p["hostedUrl"], p["applyUrl"]), F.date_format(F.timestamp_millis(p["createdAt"]), "yyyy-MM-dd'T'HH:mm:ss'Z'"), [p["categories"]["team"], p["categories"]["location"], p["categories"]["commitment"]]),
    ),
    "ashby": (
        "jobs array<struct<title:string,department:string,location:string,employmentType:string,publishedAt:string,isListed:boolean,jobUrl:string,descriptionHtml:string,descriptionPlain:string>>", "jobs",
        lambda p: (F.when(F.coalesce(p["isListed"], F.lit(True)), p["title"]), F.coalesce(p["descriptionPlain"], T.html_text(p["descriptionHtml"])), p["jobUrl"], p["publishedAt"], [p["department"], p["location"], p["employmentType"]]),
    ),
    "workable": (
        "jobs array<struct<title:string,description:string,url:string,shortlink:string,published_on:string,created_at:string,department:string,city:string,country:string,employment_type:string>>", "jobs",
        lambda p: (p["title"], T.html_text(p["description"]), F.coalesce(p["url"], p["shortlink"]), F.coalesce(p["published_on"], p["created_at"]), [p["department"], p["city"], p["country"], p["employment_type"]]),
    ),
    "recruitee": (
        "offers array<struct<title:string,status:string,description:string,requirements:string,location:string,department:string,employment_type_code:string,careers_url:string,published_at:string>>", "offers",
        lambda p: (F.when(p["status"] == "published", p["title"]), T.html_text(F.concat_ws("<br>", p["description"], p["requirements"])), p["careers_url"], F.regexp_replace(p["published_at"], " UTC$", "Z"), [p["department"], p["location"], p["employment_type_code"]]),
    ),
    "aggregator": (
        "results array<struct<title:string,description:string,created:string,redirect_url:string,company:struct<display_name:string>,location:struct<display_name:string>,category:struct<label:string>,contract_time:string>>", "results",
        lambda p: (p["title"], p["description"], p["redirect_url"], p["created"], [p["category"]["label"], p["location"]["display_name"], p["contract_time"]]),
    ),
}


def _job_documents(rows: DataFrame, kind: str) -> DataFrame:
    return to_documents(rows.where(F.coalesce(F.trim("title"), F.lit("")) != ""), "jobs", kind, T.CAPS["jobs"])


def job_postings(raw: DataFrame, kind: str) -> DataFrame:
    """Documents of a job board's postings: facts on the first lines, then the description. Unlisted postings have no title and go."""
    schema, field, read = JOB_BOARDS[kind]
    parsed = F.from_json("raw", schema)
    rows = raw.select("company_id", F.explode(parsed[field] if field else parsed).alias("p"))
    title, body, url, date, facts = read(F.col("p"))
    return _job_documents(rows.select("company_id", url.alias("url"), title.alias("title"), F.concat_ws("\n", *facts, body).alias("body"), date.alias("date")), kind)


def workday_postings(lists: DataFrame, details: DataFrame, n: int = 30) -> DataFrame:
    """Postings of a list with their details, by path; one a path, at most n. details: company_id, path, raw."""
    rows = lists.select("company_id", F.posexplode(F.from_json("raw", "jobPostings array<struct<title:string,externalPath:string,locationsText:string>>")["jobPostings"]).alias("position", "p"))
    rows = rows.select("company_id", "position", F.col("p.title").alias("_title"), F.col("p.externalPath").alias("path"), F.col("p.locationsText").alias("_where"))
    rows = most(first_by(rows, ["company_id", "path"], [F.col("position").asc()]), n, [F.col("position").asc()])
    info = F.from_json("raw", "jobPostingInfo struct<title:string,jobDescription:string,location:string,timeType:string,startDate:string,externalUrl:string>")["jobPostingInfo"]
    both = rows.join(details.select("company_id", "path", info.alias("d")), ["company_id", "path"], "left")
    body = F.concat_ws("\n", F.coalesce("d.location", "_where"), F.col("d.timeType"), T.html_text(F.col("d.jobDescription")))
    return _job_documents(both.select("company_id", F.coalesce("d.externalUrl", "path").alias("url"), F.coalesce("d.title", "_title").alias("title"), body.alias("body"), F.col("d.startDate").alias("date")), "workday")


def personio_postings(raw: DataFrame) -> DataFrame:
    """S08d: XML positions."""
    position = "struct<id:string,office:string,department:string,name:string,employmentType:string,createdAt:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>"
    rows = raw.select("company_id", F.explode(F.from_xml("raw", f"position array<{position}>")["position"]).alias("p"))
    parts = F.array_join(F.transform("p.jobDescriptions.jobDescription", lambda d: T.html_text(d["value"])), "\n")
    return _job_documents(rows.select("company_id", F.concat(F.lit("/job/"), F.col("p.id")).alias("url"), F.col("p.name").alias("title"), F.concat_ws("\n", "p.department", "p.office", "p.employmentType", parts).alias("body"), F.col("p.createdAt").alias("date")), "personio")


def smartrecruiters_postings(lists: DataFrame, details: DataFrame, with_body: int = 20) -> DataFrame:
    """S08f: postings; the first ones with the text of their details. details: company_id, id, raw."""
    item = "struct<id:string,name:string,releasedDate:string,location:struct<city:string,country:string>,function:struct<label:string>,typeOfEmployment:struct<label:string>>"
    rows = lists.select("company_id", F.posexplode(F.from_json("raw", f"content array<{item}>")["content"]).alias("position", "p")).withColumn("id", F.col("p.id"))
    d = F.from_json("raw", "jobAd struct<sections:map<string,struct<title:string,text:string>>>, postingUrl string")
    both = rows.join(details.select("company_id", "id", d.alias("d")), ["company_id", "id"], "left")
    text = T.html_text(F.array_join(F.transform(F.map_values("d.jobAd.sections"), lambda s: s["text"]), "<br>"))
    body = F.concat_ws("\n", "p.function.label", "p.location.city", "p.typeOfEmployment.label", F.when(F.col("position") < with_body, text))
    return _job_documents(both.select("company_id", F.coalesce("d.postingUrl", F.concat(F.lit("/postings/"), "id")).alias("url"), F.col("p.name").alias("title"), body.alias("body"), F.col("p.releasedDate").alias("date")), "smartrecruiters")


def prioritise(jobs: DataFrame, keywords: list[str], n: int, title: str = "title", order: str = "position") -> DataFrame:
    """Postings whose title has a keyword before the others, then in order; at most n a company."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower(title).contains(k.lower())
    return most(jobs, n, [F.desc(hit), F.col(order).asc()])


def employer_filter(jobs: DataFrame, companies: DataFrame, employer: str = "employer") -> DataFrame:
    """Postings whose employer's name has all words of the company's name."""
    words = lambda c: F.split(T.name_key(c), " ")
    named = companies.select("company_id", words(F.col("name")).alias("_wanted"))
    return jobs.join(named, "company_id").where(F.size(F.array_except("_wanted", words(F.col(employer)))) == 0).drop("_wanted")


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c]: what a domain must equal to be, or to hold, the host."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def incident_docs(breaches: DataFrame, companies: DataFrame, since: Column, n: int = 10, shared_hosts: list[str] = ()) -> DataFrame:
    """Breaches of own domains and their subdomains, met by an equi-join on domain suffixes; no fabricated or spam lists."""
    fields = "Name:string,Title:string,Domain:string,BreachDate:string,AddedDate:string,PwnCount:bigint,Description:string,DataClasses:array<string>,IsVerified:boolean,IsFabricated:boolean,IsSpamList:boolean"
    b = breaches.select(F.explode(F.from_json("raw", f"array<struct<{fields}>>")).alias("b")).select("b.*").where(~F.coalesce("IsFabricated", F.lit(False)) & ~F.coalesce("IsSpamList", F.lit(False)))
    b = b.withColumn("_added", T.utc_datetime(F.col("AddedDate"))).withColumn("_latest", F.greatest("_added", T.utc_datetime(F.col("BreachDate")))).where(F.col("_latest") >= since)
    b = b.withColumn("_suffix", F.explode(host_suffixes(T.normalize_domain(F.col("Domain")))))
    own = companies.select("company_id", F.explode(F.array_distinct(F.array_append(F.coalesce("own_domains", F.array().cast("array<string>")), F.col("domain")))).alias("_suffix")).where(~F.col("_suffix").isin(list(shared_hosts)))
    met = b.join(own, "_suffix").dropDuplicates(["company_id", "Name"])
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))
    body = F.concat_ws("\n", line("Breach date", F.col("BreachDate")), line("Accounts", F.col("PwnCount")), line("Data", F.array_join("DataClasses", ", ")), T.html_text(F.col("Description")))
    docs = to_documents(met.select("company_id", F.concat(F.lit("https://breach/"), "Name").alias("url"), "Title", body.alias("body"), F.col("_added").alias("date")).withColumnRenamed("Title", "title"), "incident", "breaches")
    return most(docs, n, [F.desc("published_at"), F.col("url").asc()])


def firmographics(raw: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item, name, country, employees, revenue, founded, industry_ids) of bindings. taxonomy: qid, industry_id."""
    v = "struct<value:string>"
    names = ["item", "itemLabel", "countryCode", "employees", "revenue", "founded", "lei", "industries"]
    rows = raw.select(F.explode(F.from_json("raw", f"results struct<bindings:array<struct<{','.join(f'{n}:{v}' for n in names)}>>>")["results"]["bindings"]).alias("b"))
    rows = rows.select(*[F.col(f"b.{n}.value").alias(n) for n in names])
    ids = rows.select("item", F.explode(F.split("industries", ",")).alias("_q")).select("item", F.element_at(F.split(F.trim("_q"), "/"), -1).alias("qid"))
    ids = ids.join(F.broadcast(taxonomy), "qid").groupBy("item").agg(F.array_sort(F.collect_set("industry_id")).alias("industry_ids"))
    num = lambda c: F.col(c).try_cast("double")
    out = rows.groupBy("item").agg(F.min("itemLabel").alias("name"), F.min("countryCode").alias("country_code"), F.max(num("employees")).cast("bigint").alias("employees"), F.max(num("revenue")).cast("bigint").alias("revenue_eur"), F.min(F.left("founded", F.lit(4)).try_cast("int")).alias("founded"), F.min("lei").alias("lei"))
    return out.join(ids, "item", "left")


def legal_entities(raw: DataFrame) -> DataFrame:
    """(lei, legal_name, country, status, registration) of landed records."""
    kind = "data array<struct<id:string,attributes:struct<lei:string,entity:struct<legalName:struct<name:string>,legalAddress:struct<country:string>,status:string>,registration:struct<status:string>>>>"
    rows = raw.select(F.explode(F.from_json("raw", kind)["data"]).alias("d")).select("d.attributes.*")
    return rows.select("lei", F.col("entity.legalName.name").alias("legal_name"), F.col("entity.legalAddress.country").alias("country_code"), F.col("entity.status").alias("status"), F.col("registration.status").alias("registration"))


def match_legal_entity(companies: DataFrame, records: DataFrame) -> DataFrame:
    """By equal name keys; live records before others; only where one is left."""
    r = records.withColumn("_key", T.name_key(F.col("legal_name"))).withColumn("_live", (F.col("status") == "ACTIVE") & (F.col("registration") != "RETIRED"))
    met = companies.select("company_id", T.name_key(F.col("name")).alias("_key")).join(r, "_key")
    group = Window.partitionBy("company_id")
    best = met.withColumn("_any", F.max("_live").over(group)).where("_live = _any")
    return best.withColumn("_n", F.count("*").over(group)).where("_n = 1").drop("_key", "_live", "_any", "_n")


def registry_docs(matched: DataFrame, parents: DataFrame) -> DataFrame:
    """Registry documents with the direct parent's name. parents: lei, parent_lei, parent_name."""
    both = matched.join(parents, "lei", "left")
    body = F.concat_ws("\n", F.concat(F.lit("LEI: "), "lei"), F.concat(F.lit("Legal name: "), "legal_name"), F.concat(F.lit("Status: "), "status"), F.concat(F.lit("Parent: "), "parent_name"))
    rows = both.select("company_id", F.concat(F.lit("https://lei/"), "lei").alias("url"), F.col("legal_name").alias("title"), body.alias("body"), F.lit(None).cast("timestamp").alias("date"))
    return to_documents(rows, "registry", "legal_entities")


def firmographic_docs(facts: DataFrame) -> DataFrame:
    """Firmographics as a document of JSON. facts: company_id, name and whatever else is known."""
    body = F.to_json(F.struct(*[c for c in sorted(facts.columns) if c != "company_id"]))
    return to_documents(facts.select("company_id", F.lit(None).cast("string").alias("url"), F.col("name").alias("title"), body.alias("body"), F.lit(None).cast("timestamp").alias("date")), "registry", "firmographics")


def coalesce_firmographics(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field, a before b."""
    x = a.select("company_id", *[F.col(f).alias(f"_a_{f}") for f in fields])
    y = b.select("company_id", *[F.col(f).alias(f"_b_{f}") for f in fields])
    return x.join(y, "company_id", "full").select("company_id", *[F.coalesce(f"_a_{f}", f"_b_{f}").alias(f) for f in fields])


def pick_entity(hits: DataFrame, companies: DataFrame) -> DataFrame:
    """Of search hits (company_id, position, entity_id, website) the one on the company's own site, else the first."""
    h = hits.join(companies.select("company_id", "domain"), "company_id").withColumn("_own", F.coalesce(T.own_host(T.host(F.col("website")), F.col("domain")), F.lit(False)))
    return first_by(h, ["company_id"], [F.desc("_own"), F.col("position").asc()]).select("company_id", "entity_id")


def load_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents of JSON lines or Parquet files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if path.rstrip("/").endswith((".jsonl", ".json", ".jsonl.gz")) else reader.parquet(path)
