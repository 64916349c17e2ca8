"""Lead analytics: statistics, lists, trends, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["company_id", "service_id"]
# Trend of each category, and terms of job cuts.
KINDS = {
    "hiring": "hiring", "distress": "distress", "cost_efficiency": "cost_cutting", "incident": "cyber_incident", "leadership_change": "leadership_change",
    "expansion": "growth", "investment": "growth", "ai_automation": "ai_automation", "digital_transformation": "ai_automation", "compliance": "compliance",
}
LAYOFF_TERMS = ["layoff", "job cut", "stellenabbau", "redundanc"]
RANKS = {"weak": 1, "moderate": 2, "strong": 3}


def trend_kind(category: Column, *texts: Column) -> Column:
    """Null for categories without a trend."""
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(category == k, v).otherwise(out)
    said = F.lower(F.concat_ws(" ", *texts))
    cuts = F.lit(False)
    for t in LAYOFF_TERMS:
        cuts = cuts | said.contains(t)
    return F.when((category == "distress") & cuts, "layoffs").otherwise(out)


def strength_rank(strength: Column) -> Column:
    """L09."""
    out = F.lit(0)
    for k, v in RANKS.items():
        out = F.when(strength == k, v).otherwise(out)
    return out


def signal_date(event_date: Column, detected_at: Column) -> Column:
    """L09."""
    return F.coalesce(event_date, detected_at.cast("date"))


def active(signals: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    out = signals.where("status = 'active'")
    return out if questions is None else out.join(F.broadcast(questions.where("is_active").select("question_id")), "question_id", "left_semi")


def signal_stats(signals: DataFrame, questions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """L01."""
    date = signal_date(F.col("event_date"), F.col("detected_at"))
    return active(signals, questions).groupBy(*KEYS).agg(
        F.count("*").alias("n_signals"), F.count_if(F.col("detected_at") >= now - F.make_dt_interval(F.lit(days))).alias("n_new"), F.max(date).alias("latest")
    )


def jobs_open(docs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """L02."""
    return docs.where((F.col("source_type") == "jobs") & (F.col("published_on") >= F.date_sub(now, days))).groupBy("company_id").agg(F.count("*").alias("jobs_open"))


def with_trend(leads: DataFrame, signals: DataFrame, kinds: list[str] | None = None, least: str = "weak") -> DataFrame:
    """Leads with an active signal of one of the kinds (any kind if none is given) and at least that strength."""
    s = active(signals).withColumn("kind", trend_kind(F.col("category"), F.col("quote")))
    s = s.where(F.col("kind").isin(kinds) if kinds else F.col("kind").isNotNull()).where(strength_rank(F.col("strength")) >= RANKS[least])
    return leads.join(s.select(*KEYS), KEYS, "left_semi")


def leads(scores: DataFrame, companies: DataFrame, stats: DataFrame, jobs: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """L04, before filters and order: scores with company, statistics, jobs and the watched flag."""
    out = scores.join(companies, "company_id").join(stats, KEYS, "left").join(jobs, "company_id", "left")
    if watched is not None:
        out = out.join(watched.select("company_id").distinct().withColumn("is_watched", F.lit(True)), "company_id", "left")
    return out.fillna(0, ["n_signals", "n_new", "jobs_open"]).fillna(False, ["is_watched"] if watched is not None else [])


def lead_filters(df: DataFrame, q: str | None = None, countries=None, industries=None, tiers=None, employees_min=None, employees_max=None, least_priority=None, watched=None) -> DataFrame:
    """L04, L06, L07."""
    if q:
        df = df.where(F.col("name").ilike(f"%{q}%") | F.col("domain").ilike(f"%{q}%"))
    if countries:
        df = df.where(F.col("country_code").isin(countries))
    if industries:
        df = df.where(F.arrays_overlap("industry_ids", F.array(*map(F.lit, industries))))
    if tiers:
        df = df.where(F.col("tier").isin(tiers))
    if employees_min is not None:
        df = df.where(F.col("employees") >= employees_min)
    if employees_max is not None:
        df = df.where(F.col("employees") <= employees_max)
    if least_priority is not None:
        df = df.where(F.col("priority") >= least_priority)
    return df.where("is_watched") if watched else df


SORTS = ["priority", "intent", "fit", "risk", "name", "n_new", "latest"]


def lead_order(sort: str = "priority", direction: str = "desc") -> list[Column]:
    """Nulls last, ties by id. A name descends only if asked to; all else ascends only if asked to."""
    if sort not in SORTS:
        raise ValueError(sort)
    down = direction == "desc" if sort == "name" else direction != "asc"
    key = F.lower(sort) if sort == "name" else F.col(sort)
    return [key.desc_nulls_last() if down else key.asc_nulls_last(), F.col("company_id").asc(), F.col("service_id").asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def trends(signals: DataFrame) -> DataFrame:
    """(company, service, kind, n, latest, strength)."""
    s = active(signals).withColumn("kind", trend_kind(F.col("category"), F.col("quote"))).where("kind is not null")
    date = signal_date(F.col("event_date"), F.col("detected_at"))
    return s.groupBy(*KEYS, "kind").agg(F.countDistinct("evidence_key").alias("n"), F.max(date).alias("latest"), F.max(strength_rank(F.col("strength"))).alias("strength"))


def trend_lists(found: DataFrame) -> DataFrame:
    """One row a pair, kinds by number, then name."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "kind", "n")))
    return found.groupBy(*KEYS).agg(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["n"].cast("string"))).alias("trends"))


def tier_summary(scores: DataFrame) -> DataFrame:
    """Totals by tier."""
    return scores.agg(F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("hot", "warm", "cold", "disqualified")])


def kind_summary(signals: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Distinct evidence by kind; new signals are counted without a kind as well."""
    s = active(signals).withColumn("kind", trend_kind(F.col("category"), F.col("quote")))
    return s.groupBy("kind").agg(F.countDistinct("evidence_key").alias("n"), F.count_if(F.col("detected_at") >= now - F.make_dt_interval(F.lit(days))).alias("n_new"))


def rule_flags(hits: Column) -> Column:
    """L12."""
    return F.array_distinct(F.transform(hits, lambda h: h["name"]))


def best_service(scores: DataFrame, services: DataFrame) -> DataFrame:
    """Active first, then priority, intent, fit, slug; of a company without scores the first active service."""
    order = Window.partitionBy("company_id").orderBy(F.desc("is_active"), F.desc("priority"), F.desc("intent"), F.desc("fit"), "slug", "service_id")
    return scores.join(F.broadcast(services), "service_id").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("company_id", "service_id", "slug", "priority")


def lead_card(questions: DataFrame, signals: DataFrame, points: DataFrame) -> DataFrame:
    """For each pair its questions by points, each with its signals by confidence and time."""
    row = F.struct((-F.col("confidence")).alias("c"), (-F.unix_micros(F.col("detected_at").cast("timestamp"))).alias("t"), "signal_id")
    s = active(signals).groupBy(*KEYS, "question_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["signal_id"]).alias("signals"))
    out = s.join(F.broadcast(questions.where("is_active")), "question_id").join(points.select(*KEYS, "question_id", "points"), [*KEYS, "question_id"], "left")
    return out.select(*KEYS, "question_id", "question_key", F.coalesce("points", F.lit(0.0)).alias("points"), "signals")


def unanswered(questions: DataFrame, signals: DataFrame) -> DataFrame:
    """(company, service, question) of active questions without an active signal."""
    pairs = active(signals).select(*KEYS).distinct()
    every = pairs.crossJoin(F.broadcast(questions.where("is_active").select("question_id", "question_key")))  # a row for each question
    return every.join(active(signals).select(*KEYS, "question_id"), [*KEYS, "question_id"], "left_anti")


def sources_summary(docs: DataFrame) -> DataFrame:
    """L15."""
    return docs.groupBy("source_type").agg(F.count("*").alias("n"))


def score_history(scores: DataFrame, n: int = 10) -> DataFrame:
    """The last scores of each pair."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("computed_at"), F.desc("score_id"))
    return scores.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def my_feedback(signals: DataFrame, votes: DataFrame) -> DataFrame:
    """A user's verdict on a signal, else the latest one on the same evidence. votes: target_id, evidence_key, verdict, version."""
    direct = votes.groupBy("target_id").agg(F.max_by("verdict", "version").alias("_direct"))
    same = votes.where("evidence_key is not null").groupBy("evidence_key").agg(F.max_by("verdict", "version").alias("_same"))
    out = signals.join(direct, signals["signal_id"] == direct["target_id"], "left").join(same, "evidence_key", "left")
    return out.withColumn("verdict", F.coalesce("_direct", "_same")).drop("_direct", "_same", "target_id")


def current_score(companies: DataFrame, scores: DataFrame, profiles: DataFrame) -> DataFrame:
    """L18."""
    return companies.join(scores.where("is_current"), "company_id", "left").join(F.broadcast(profiles.select("profile_id", "version")), "profile_id", "left")


def company_list(companies: DataFrame, q: str | None = None, tracked: bool | None = None, size: int = 50) -> DataFrame:
    """Newest first."""
    if q:
        companies = companies.where(F.col("name").ilike(f"%{q}%") | F.col("domain").ilike(f"%{q}%"))
    if tracked is not None:
        companies = companies.where(F.col("is_tracked") == tracked)
    return companies.orderBy(F.desc("company_id")).limit(size)


def company_documents(docs: DataFrame, company_id, size: int = 20) -> DataFrame:
    """L20."""
    return docs.where(F.col("company_id") == company_id).orderBy(F.col("published_on").desc_nulls_last(), "doc_id").limit(size)


def export_rows(leads_: DataFrame) -> DataFrame:
    """The columns of the CSV export, lists joined by "; "."""
    lists = {c for c, t in leads_.dtypes if t.startswith("array")}
    return leads_.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if c in lists else F.col(c) for c in leads_.columns])


def export_leads(leads_: DataFrame, path: str) -> None:
    """CSV files, a header in each."""
    export_rows(leads_).write.option("header", True).csv(path)


def crm_snapshot(scores: DataFrame, signals: DataFrame, n: int = 3) -> DataFrame:
    """A company's best score and its strongest evidence."""
    top = Window.partitionBy("company_id").orderBy(F.desc("priority"), "service_id")
    best = scores.withColumn("_nth", F.row_number().over(top)).where("_nth = 1").drop("_nth")
    strongest = Window.partitionBy(*KEYS).orderBy(F.desc(strength_rank(F.col("strength"))), F.desc("confidence"), F.col("event_date").desc_nulls_last(), "signal_id")
    some = active(signals).withColumn("nth", F.row_number().over(strongest)).where(F.col("nth") <= n)
    ids = some.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "signal_id"))), lambda r: r["signal_id"]).alias("evidence"))
    return best.join(ids, KEYS, "left")
