"""Scoring: decay, noisy-OR per question, saturation, fit, rules, tiers. All companies and services at once.

Signals, questions and profiles are joined by key; nothing is computed a company at
a time. Parameters are literals of a :class:`Profile`, or columns where many
profiles are scored at once (``what_if``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, source_key
from ..storage import checkpointed
from .clusters import event_clusters
from .verify import cluster_leads

KEYS = ["company_id", "service_id"]


@dataclass(frozen=True)
class Profile:
    """Parameters of a score. The values are the defaults that hold where none are set."""

    weights: dict = field(default_factory=lambda: {"high": 3.0, "medium": 2.0, "low": 1.0})
    strengths: dict = field(default_factory=lambda: {"weak": 0.35, "moderate": 0.65, "strong": 1.0})
    reliability: dict = field(default_factory=lambda: {"website": 1.0, "report": 1.0, "jobs": 0.9, "incident": 0.9, "registry": 0.9, "news": 0.8, "derived": 0.7, "headline_only": 0.6})
    half_life_days: dict = field(default_factory=lambda: {"jobs": 45, "news": 120, "website": 240, "report": 365, "incident": 270})
    tau_intent: float = 5.0
    tau_risk: float = 2.0
    fit_exponent: float = 0.4
    intent_exponent: float = 0.6
    risk_penalty: float = 0.5
    hot: float = 65.0
    warm: float = 40.0
    min_confidence: float = 0.5
    max_evidence: int = 3
    fit_floor: float = 20.0
    undated_age_days: int = 90


def lookup(values: dict, key: Column, default: float | None = None) -> Column:
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def evidence_date(event_date: Column, published_at: Column) -> Column:
    """G01."""
    return F.coalesce(event_date.cast("date"), published_at.cast("date"))


def age_days(date: Column, seen_at: Column, now: Column, undated: int = Profile.undated_age_days) -> Column:
    """Never negative; without a date at least ``undated`` days."""
    dated = F.greatest(F.lit(0), F.datediff(now, date))
    return F.when(date.isNotNull(), dated).otherwise(F.greatest(F.datediff(now, seen_at), F.lit(undated)))


#: Days whose decay is read from a table.
DAYS = 2000


def halved(age: Column, half: float) -> Column:
    """0.5 ** (age / half). The JVM's power differs from that of C and Python in the last bit for one age of twelve, which decides between clusters of the same value; so whole days up to DAYS are read from a table."""
    known = F.split(F.lit(",".join(repr(0.5 ** (a / half)) for a in range(DAYS))), ",").cast("array<double>")
    return F.when(age < DAYS, F.get(known, age)).otherwise(F.pow(F.lit(0.5), age / half))


def decay(source_type: Column, age: Column, p: Profile = Profile()) -> Column:
    """Halves every half-life; 1 for sources without one."""
    out = F.lit(1.0)
    for k, v in p.half_life_days.items():
        out = F.when(source_type == k, halved(age, float(v))).otherwise(out)
    return out


def reliability(source_type: Column, flags: Column | None, stored: Column | None, p: Profile = Profile()) -> Column:
    """Of headlines alone, else of the source, else as stored."""
    known = lookup({k: v for k, v in p.reliability.items() if k != "headline_only"}, source_type)
    out = F.coalesce(known, stored if stored is not None else F.lit(1.0))
    return out if flags is None else F.when(F.array_contains(flags, "headline_only"), F.lit(p.reliability["headline_only"])).otherwise(out)


def signal_value(strength: Column, confidence: Column, reliability_: Column, decay_: Column, p: Profile = Profile()) -> Column:
    """G05."""
    return lookup(p.strengths, strength, 0.0) * confidence * reliability_ * decay_


def noisy_or(value: Column) -> Column:
    """G06, an aggregate: 1 - product(1 - v), v held in [0, 1]."""
    return F.lit(1.0) - F.product(F.lit(1.0) - F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def saturate(points: Column, tau: float | Column) -> Column:
    """G08."""
    return 100 * (1 - F.exp(-points / tau))


def priority(fit: Column, intent: Column, risk: Column, p: Profile = Profile()) -> Column:
    """G09."""
    return 100 * F.pow(fit / 100, F.lit(p.fit_exponent)) * F.pow(intent / 100, F.lit(p.intent_exponent)) * (1 - p.risk_penalty * risk / 100)


def tier(priority_: Column, disqualified: Column, p: Profile = Profile()) -> Column:
    """By the priority rounded to one digit."""
    shown = F.bround(priority_, 1)
    return F.when(disqualified, "disqualified").when(shown >= p.hot, "hot").when(shown >= p.warm, "warm").otherwise("cold")


def scorable(signals: DataFrame, p: Profile = Profile()) -> DataFrame:
    """G12."""
    return signals.where((F.col("status") == "active") & (F.col("confidence") >= p.min_confidence))


def valued(signals: DataFrame, now: Column, p: Profile = Profile()) -> DataFrame:
    """Signals with date (G01), age (G02), decay (G03) and value."""
    date = evidence_date(F.col("event_date"), F.col("published_at") if "published_at" in signals.columns else F.lit(None))
    seen = F.col("fetched_at") if "fetched_at" in signals.columns else F.col("detected_at")
    out = signals.withColumn("age", age_days(date, seen, now, p.undated_age_days)).withColumn("decay", decay(F.col("source_type"), F.col("age"), p))
    flags, stored = (F.col(c) if c in signals.columns else None for c in ("flags", "reliability"))
    return out.withColumn("value", signal_value(F.col("strength"), F.col("confidence"), reliability(F.col("source_type"), flags, stored, p), F.col("decay"), p))


def corroborated(values: DataFrame) -> DataFrame:
    """(company, service, question, signal_id, value): clusters of signals of one event, by their leads, with the confidence of all their sources.

    Signals without quotes are clusters of their own. Sources are told apart by
    source_key, or url and document_id, where these are there.
    """
    keys = [*KEYS, "question_id"]
    if "quote" not in values.columns:
        return values.select(*keys, "signal_id", "value")
    document = F.col("document_id").cast("string") if "document_id" in values.columns else F.col("signal_id").cast("string")
    source = F.col("source_key") if "source_key" in values.columns else source_key(F.col("url"), document) if "url" in values.columns else document
    date = evidence_date(F.col("event_date"), F.col("published_at") if "published_at" in values.columns else F.lit(None))
    summary = F.col("summary") if "summary" in values.columns else F.lit(None).cast("string")
    s = values.select(*keys, "signal_id", "value", "confidence", "quote", date.alias("date"), summary.alias("summary"), document.alias("document_id"), source.alias("source_key"))
    return cluster_leads(event_clusters(s, keys), keys).select(*keys, F.col("lead").alias("signal_id"), "value")


def question_strength(values: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(company, service, question, s): noisy-OR of the best clusters (corroborated()) of a question.

    The best of a question are kept by a rank of at most max_evidence, which Spark
    applies before the exchange, so a question with many signals stays small.
    """
    order = Window.partitionBy(*KEYS, "question_id").orderBy(F.desc("value"), "signal_id")
    best = values.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= p.max_evidence)
    return best.groupBy(*KEYS, "question_id").agg(noisy_or(F.col("value")).alias("s"), F.count("*").alias("n_evidence"))


def question_points(strengths: DataFrame, questions: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Strengths with points and polarity, of active questions."""
    active = questions.where("is_active").select("question_id", "question_key", "polarity", "weight")
    return strengths.join(F.broadcast(active), "question_id").withColumn("points", lookup(p.weights, F.col("weight"), 0.0) * F.col("s"))


def intent_risk(points: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(company, service, intent, risk)."""
    side = lambda polarity: F.coalesce(F.sum(F.when(F.col("polarity") == polarity, F.col("points"))), F.lit(0.0))
    sums = points.groupBy(*KEYS).agg(side("positive").alias("positive"), side("negative").alias("negative"))
    return sums.select(*KEYS, saturate(F.col("positive"), p.tau_intent).alias("intent"), saturate(F.col("negative"), p.tau_risk).alias("risk"))


def breakdown(points: DataFrame) -> DataFrame:
    """(company, service, breakdown): questions by rounded points, then in order."""
    row = F.struct((-F.bround("points", 2)).alias("minus"), F.col("question_id"), F.bround("points", 2).alias("points"), F.bround("s", 2).alias("strength"), "question_key", "polarity")
    return points.groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(*KEYS, F.transform("_rows", lambda r: F.struct(r["question_key"].alias("question_key"), r["polarity"].alias("polarity"), r["strength"].alias("strength"), r["points"].alias("points"))).alias("breakdown"))


def fit_checks(companies: DataFrame, icp: dict) -> DataFrame:
    """Must-haves as true, false or null (unknown): country, industry, employees, revenue."""
    checks = []

    def add(kind: str, known: Column, met: Column) -> None:
        checks.append(F.struct(F.lit(kind).alias("kind"), F.when(known, met).alias("met")))

    if icp.get("countries"):
        add("country", F.col("country_code").isNotNull(), F.col("country_code").isin(icp["countries"]))
    if icp.get("industries_any"):
        add("industry", F.size("industry_ids") > 0, F.arrays_overlap("industry_ids", F.array(*map(F.lit, icp["industries_any"]))))
    low, high = icp.get("employees_min"), icp.get("employees_max")
    if low is not None or high is not None:
        add("employees", F.col("employees").isNotNull(), F.col("employees").between(low if low is not None else 0, high if high is not None else 2**62))
    if icp.get("revenue_min_eur") is not None:
        add("revenue", F.col("revenue_eur").isNotNull(), F.col("revenue_eur") >= icp["revenue_min_eur"])
    none = F.array().cast("array<struct<kind:string,met:boolean>>")
    return companies.withColumn("checks", F.array(*checks) if checks else none)


def fit(companies: DataFrame, icp: dict, p: Profile = Profile()) -> DataFrame:
    """Companies with fit, failed must-haves, data gaps and details. Unknown criteria count half."""
    out = fit_checks(companies, icp)
    wishes, gaps = [], []
    for c in icp.get("nice_to_have", []):
        values = F.array(*map(F.lit, c["values"]))
        column, known = {
            "country": (F.col("country_code").isin(c["values"]), F.col("country_code").isNotNull()),
            "industry": (F.arrays_overlap("industry_ids", values), F.size("industry_ids") > 0),
            "tag": (F.arrays_overlap("tags", values), F.lit(True)),
        }[c["kind"]]
        share = F.when(~known, 0.5).when(column, 1.0).otherwise(0.0)
        wishes.append((share, float(c["weight"])))
        gaps.append(F.when(~known, F.lit(c["kind"])))
    total = sum(w for _, w in wishes)
    share = sum((s * w for s, w in wishes), F.lit(0.0)) / total if total else F.lit(1.0)
    failed = F.transform(F.filter("checks", lambda c: c["met"] == F.lit(False)), lambda c: c["kind"])
    unknown = F.transform(F.filter("checks", lambda c: c["met"].isNull()), lambda c: c["kind"])
    more = F.filter(F.array(*gaps) if gaps else F.array().cast("array<string>"), lambda g: g.isNotNull())
    out = out.withColumn("failed", failed).withColumn("data_gaps", F.array_distinct(F.concat(unknown, more)))
    return out.withColumn("fit", F.when(F.size("failed") > 0, 0.0).otherwise(p.fit_floor + (100 - p.fit_floor) * share))


def firmographic_list_rule(op: Column, values: Column, wanted: Column) -> Column:
    """G16 for a list of values: in, eq and intersects are one; null and empty lists never fire. Case does not matter."""
    meets = F.arrays_overlap(F.transform(values, casefold), F.transform(wanted, casefold))
    fires = F.when(op.isin("in", "eq", "intersects"), meets).when(op == "not_in", ~meets).otherwise(F.lit(False))
    return F.coalesce((F.size(values) > 0) & fires, F.lit(False))


def firmographic_rule(op: Column, value: Column, wanted: Column) -> Column:
    """G16 for one value: wanted is an array of strings; null never fires. Case does not matter."""
    one = F.element_at(wanted, 1)
    inside = F.array_contains(F.transform(wanted, casefold), casefold(value.cast("string")))
    number = one.try_cast("double")
    fires = F.when(op == "lt", value.try_cast("double") < number).when(op == "gt", value.try_cast("double") > number)
    return F.coalesce(fires.when(op.isin("eq", "in", "intersects"), inside).when(op == "not_in", ~inside).otherwise(F.lit(False)), F.lit(False))


def list_rule(domain: Column, own_domains: Column, listed: Column) -> Column:
    """Domains in lower case, without www."""
    bare = lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", "")
    return F.arrays_overlap(F.transform(F.array_append(F.coalesce(own_domains, F.array().cast("array<string>")), domain), bare), F.transform(listed, bare))


def signal_rule(strengths: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of rules on a question's strength."""
    return strengths.join(F.broadcast(rules.where("kind = 'question'")), ["service_id", "question_key"]).where("s >= min_strength")


def apply_rules(scores: DataFrame, hits: DataFrame) -> DataFrame:
    """Exclusion sets priority 0, caps lower it, flags are listed. scores: company, service, priority."""
    each = hits.groupBy(*KEYS).agg(
        F.bool_or(F.col("action") == "exclude").alias("excluded"),
        F.min(F.when(F.col("action") == "cap", F.col("cap_value"))).alias("cap"),
        F.array_sort(F.collect_set("name")).alias("hits"),
    )
    out = scores.drop("disqualified", "hits").join(each, KEYS, "left")
    excluded = F.coalesce("excluded", F.lit(False))
    capped = F.least(F.col("priority"), F.coalesce("cap", F.lit(100.0)))
    return out.withColumn("disqualified", excluded).withColumn("priority", F.when(F.col("disqualified"), 0.0).otherwise(capped)).drop("excluded", "cap")


# Member states of the EU, and annexes of the NIS2 directive by industry.
EU = ["AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"]
NIS2_ANNEX = {
    "energy_utilities": "I", "oil_gas": "I", "airlines": "I", "rail": "I", "logistics": "I", "banking": "I", "financial_markets": "I", "healthcare": "I", "pharma": "I", "water": "I",
    "digital_infrastructure": "I", "telecom": "I", "public_sector": "I", "it_services": "I", "postal_courier": "II", "chemicals": "II", "food_beverage": "II", "manufacturing": "II", "automotive": "II", "medical_devices": "II",
}
DORA = ["banking", "insurance", "financial_markets"]
# Strength of each scope, and the confidence of both.
DERIVED_STRENGTH, DERIVED_CONFIDENCE = {"nis2": "weak", "dora": "moderate"}, 0.8


def derived_signals(companies: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """Signals that follow from master data: NIS2 and DORA scope, at the first positive compliance question of each service."""
    annex = F.filter(F.transform("industry_ids", lambda i: F.coalesce(*[F.when(i == k, F.lit(v)) for k, v in NIS2_ANNEX.items()])), lambda x: x.isNotNull())
    large = (F.col("employees") >= 50) | (F.col("revenue_eur") > 10_000_000)
    eu = F.col("country_code").isin(EU)
    scopes = F.array(
        F.when(eu & (F.size(annex) > 0) & large, F.struct(F.lit("nis2").alias("source_name"), F.concat(F.lit("NIS2 annex "), F.array_min(annex)).alias("quote"))),
        F.when(eu & F.arrays_overlap("industry_ids", F.array(*map(F.lit, DORA))), F.struct(F.lit("dora").alias("source_name"), F.lit("DORA scope").alias("quote"))),
    )
    first = questions.where("is_active and polarity = 'positive' and category = 'compliance'").groupBy("service_id").agg(F.min("question_id").alias("question_id"))
    rows = companies.select("company_id", F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("s")).select("company_id", "s.*")
    out = rows.crossJoin(F.broadcast(first))  # a row for each service
    key = F.sha2(F.concat_ws(":", "company_id", "question_id", "source_name"), 256)
    return out.select(key.alias("signal_id"), "company_id", "service_id", "question_id", "source_name", "quote", F.lit("derived").alias("source_type"), F.when(F.col("source_name") == "nis2", DERIVED_STRENGTH["nis2"]).otherwise(DERIVED_STRENGTH["dora"]).alias("strength"), F.lit(DERIVED_CONFIDENCE).alias("confidence"), now.cast("date").alias("event_date"), F.lit("active").alias("status"))


def refresh_derived(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored signals with their derived rows replaced; the id of the same company, question and source is kept."""
    same = ["company_id", "service_id", "question_id", "source_name"]
    old = stored.where("source_type = 'derived'").groupBy(*same).agg(F.min("signal_id").alias("_old"))
    new = fresh.join(old, same, "left").withColumn("signal_id", F.coalesce("_old", "signal_id")).drop("_old")
    return stored.where("source_type <> 'derived'").unionByName(new, allowMissingColumns=True)


def fit_reasons(fits: DataFrame) -> DataFrame:
    """(company, reasons): must-haves that fail, and what is unknown. fits: from fit()."""
    outside = F.transform("failed", lambda x: F.concat(F.lit("Outside ICP: "), x))
    gaps = F.when(F.size("data_gaps") > 0, F.array(F.concat(F.lit("Unknown: "), F.array_join("data_gaps", ", ")))).otherwise(F.array().cast("array<string>"))
    return fits.select("company_id", F.concat(outside, gaps).alias("reasons"))


def why_now(points: DataFrame, values: DataFrame, scores: DataFrame, least_risk: float = 20.0, n: int = 3) -> DataFrame:
    """(company, service, why_now): the lead of the best cluster of the three best positive questions, and of the worst negative one if risk is high.

    values: from corroborated(). What the fit adds is in fit_reasons().
    """
    best = values.where("value > 0").groupBy(*KEYS, "question_id").agg(F.max_by("signal_id", F.struct("value", (-F.col("signal_id")).alias("i"))).alias("signal_id"))
    shown = points.where(F.bround("points", 2) > 0).join(best, [*KEYS, "question_id"])
    order = Window.partitionBy(*KEYS, "polarity").orderBy(F.desc(F.bround("points", 2)), "question_id")
    top = shown.withColumn("nth", F.row_number().over(order)).join(scores.select(*KEYS, "risk"), KEYS)
    kept = top.where(((F.col("polarity") == "positive") & (F.col("nth") <= n)) | ((F.col("polarity") == "negative") & (F.col("nth") == 1) & (F.col("risk") >= least_risk)))
    rows = F.array_sort(F.collect_list(F.struct((F.col("polarity") == "negative").alias("negative"), "nth", "question_key", "signal_id")))
    return kept.groupBy(*KEYS).agg(rows.alias("_rows")).select(*KEYS, F.transform("_rows", lambda r: F.concat_ws(":", r["question_key"], r["signal_id"].cast("string"))).alias("why_now"))


def ranked_pairs(companies: DataFrame, services: DataFrame, sides: DataFrame, p: Profile, hits: DataFrame | None) -> DataFrame:
    """Figures, tier and hits of every company and service, unrounded."""
    failed = F.col("failed") if "failed" in companies.columns else F.array().cast("array<string>")
    pairs = companies.select("company_id", "fit", failed.alias("_failed")).crossJoin(services.select("service_id").distinct())  # every service for each company: the result itself
    both = pairs.join(sides, KEYS, "left").fillna(0.0, ["intent", "risk"])
    return _ruled(both.withColumn("priority", priority(F.col("fit"), F.col("intent"), F.col("risk"), p)), hits, p)


def _ruled(ranked: DataFrame, hits: DataFrame | None, p: Profile | None, levels: tuple[Column, Column] | None = None) -> DataFrame:
    """Rules and failed must-haves over priorities, and the tiers that follow."""
    if hits is None:
        ruled = ranked.withColumn("disqualified", F.lit(False)).withColumn("hits", F.array().cast("array<string>"))
    else:
        ruled = apply_rules(ranked, hits).withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    outside = F.size("_failed") > 0
    icp = F.when(outside, F.array(F.concat(F.lit("Outside ICP: "), F.array_join("_failed", "; ")))).otherwise(F.array().cast("array<string>"))
    shown = F.bround("priority", 1)
    hot, warm = levels or (F.lit(p.hot), F.lit(p.warm))
    level = F.when(F.col("disqualified"), "disqualified").when(shown >= hot, "hot").when(shown >= warm, "warm").otherwise("cold")
    return ruled.withColumn("hits", F.concat("hits", icp)).withColumn("outside_icp", outside).withColumn("tier", level)


FIGURES = ("fit", "intent", "risk", "priority")


def score(companies: DataFrame, signals: DataFrame, questions: DataFrame, now: Column, p: Profile = Profile(), *, hits: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """(company, service, fit, intent, risk, priority, disqualified, tier, hits, outside_icp) of every company and service, figures to one digit.

    companies: company_id, fit, and failed must-haves where fit() found them; services:
    service_id, by default those of the signals; hits: of rules (G16-G18). Only a rule
    that excludes disqualifies; a failed must-have is listed as a hit.
    """
    points = question_points(question_strength(corroborated(valued(scorable(signals, p), now, p)), p), questions, p)
    out = ranked_pairs(companies, signals if services is None else services, intent_risk(points, p), p, hits)
    return out.select(*KEYS, *[F.bround(c, 1).alias(c) for c in FIGURES], "disqualified", "tier", "hits", "outside_icp")


def with_derived(signals: DataFrame, companies: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """Stored signals, with those that follow from today's master data in place of the derived ones stored before. Numeric ids stay numeric."""
    fresh = derived_signals(companies, questions, now)
    if signals.schema["signal_id"].dataType.typeName() != "string":
        fresh = fresh.withColumn("signal_id", F.conv(F.substring("signal_id", 1, 15), 16, 10).cast(signals.schema["signal_id"].dataType))
    stored = signals if "source_name" in signals.columns else signals.withColumn("source_name", F.lit(None).cast("string"))
    return refresh_derived(stored, fresh)


def score_rows(companies: DataFrame, signals: DataFrame, questions: DataFrame, now: Column, p: Profile = Profile(), *, hits: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """G23, whole rows: score() over stored and derived signals, with breakdown (G11), why_now (G22), reasons and data_gaps of the fit.

    companies: from fit(), with country_code, industry_ids, employees and revenue_eur;
    questions: with service_id and category, which derived signals go by. The clusters
    are found once and read for the strengths and for the reasons.
    """
    values = checkpointed(corroborated(valued(scorable(with_derived(signals, companies, questions, now), p), now, p)))
    asked = questions.select("question_id", "question_key", "polarity", "weight", "is_active").distinct()
    points = question_points(question_strength(values, p), asked, p)
    sides = intent_risk(points, p)
    out = ranked_pairs(companies, signals if services is None else services, sides, p, hits).join(breakdown(points), KEYS, "left").join(why_now(points, values, sides), KEYS, "left")
    out = out.join(fit_reasons(companies).join(companies.select("company_id", "data_gaps"), "company_id"), "company_id")
    nothing = F.array().cast("array<string>")
    more = [F.coalesce("breakdown", F.array().cast(breakdown(points).schema["breakdown"].dataType)).alias("breakdown"), F.coalesce("why_now", nothing).alias("why_now"), "reasons", "data_gaps"]
    return out.select(*KEYS, *[F.bround(c, 1).alias(c) for c in FIGURES], "disqualified", "tier", "hits", "outside_icp", *more)


#: Parameters that change how a signal is valued or chosen; profiles that share them share their strengths.
EVIDENCE = ("strengths", "reliability", "half_life_days", "min_confidence", "max_evidence", "undated_age_days")


def what_if(companies: DataFrame, signals: DataFrame, questions: DataFrame, now: Column, variants: dict[str, dict], p: Profile = Profile(), *, hits: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """score() under several profiles at once, with profile.

    Strengths are summed once for each polarity and weight of a company and service; the
    profiles are rows of a table of parameters that meets these sums in one pass, so
    more profiles are more rows, not more plans. Profiles that value evidence otherwise
    have strengths of their own, one set for each different way.
    """
    profiles = {name: replace(p, **change) for name, change in variants.items()}
    ways: dict = {}
    for name, q in profiles.items():
        ways.setdefault(repr([getattr(q, c) for c in EVIDENCE]), []).append(name)
    kinds = sorted({w for q in profiles.values() for w in q.weights})
    parts = [(polarity, w) for polarity in ("positive", "negative") for w in kinds]
    active = F.broadcast(questions.where("is_active").select("question_id", "polarity", "weight").distinct())
    pairs = companies.select("company_id", "fit", (F.col("failed") if "failed" in companies.columns else F.array().cast("array<string>")).alias("_failed")).crossJoin((signals if services is None else services).select("service_id").distinct())
    out = None
    for names in ways.values():
        one = profiles[names[0]]
        strengths = question_strength(corroborated(valued(scorable(signals, one), now, one)), one).join(active, "question_id")
        sums = strengths.groupBy(*KEYS).agg(*[F.sum(F.when((F.col("polarity") == polarity) & (F.col("weight") == w), F.col("s"))).alias(f"_{polarity}_{w}") for polarity, w in parts])
        rows = F.array(*[F.struct(F.lit(n).alias("profile"), *[F.lit(float(profiles[n].weights.get(w, 0.0))).alias(f"_w_{w}") for w in kinds], *[F.lit(float(getattr(profiles[n], c))).alias(f"_{c}") for c in ("tau_intent", "tau_risk", "fit_exponent", "intent_exponent", "risk_penalty", "hot", "warm")]) for n in names])
        both = pairs.join(sums, KEYS, "left").withColumn("_p", F.explode(rows)).select("*", "_p.*").drop("_p")
        side = lambda polarity: sum((F.coalesce(F.col(f"_{polarity}_{w}"), F.lit(0.0)) * F.col(f"_w_{w}") for w in kinds), F.lit(0.0))
        both = both.withColumn("intent", saturate(side("positive"), F.col("_tau_intent"))).withColumn("risk", saturate(side("negative"), F.col("_tau_risk")))
        worth = 100 * F.pow(F.col("fit") / 100, F.col("_fit_exponent")) * F.pow(F.col("intent") / 100, F.col("_intent_exponent")) * (1 - F.col("_risk_penalty") * F.col("risk") / 100)
        done = _ruled(both.withColumn("priority", worth), hits, None, (F.col("_hot"), F.col("_warm")))
        done = done.select("profile", *KEYS, *[F.bround(c, 1).alias(c) for c in FIGURES], "disqualified", "tier", "hits", "outside_icp")
        out = done if out is None else out.unionByName(done)
    return out


def rescore(current: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, tier changes): the pairs scored now replace the current rows; the old ones stay as history."""
    touched = fresh.select(*KEYS).distinct()
    old = current.join(touched.withColumn("_t", F.lit(True)), KEYS, "left").withColumn("is_current", F.col("is_current") & F.col("_t").isNull()).drop("_t")
    snapshots = old.unionByName(fresh.withColumn("is_current", F.lit(True)), allowMissingColumns=True)
    before = current.where("is_current").select(*KEYS, F.col("tier").alias("tier_before"))
    changes = fresh.select(*KEYS, "tier").join(before, KEYS, "left").where(~F.col("tier").eqNullSafe(F.col("tier_before")))
    return snapshots, changes


def rescore_company(current: DataFrame, fresh: DataFrame, company_id) -> tuple[DataFrame, DataFrame]:
    """G25."""
    return rescore(current, fresh.where(F.col("company_id") == company_id))


def score_changes(scores: DataFrame, value: str = "priority") -> DataFrame:
    """Each score with the one before it."""
    order = Window.partitionBy(*KEYS).orderBy("computed_at", "score_id")
    return scores.withColumn("before", F.lag(value).over(order)).withColumn("change", F.col(value) - F.col("before"))


def ranking(scores: DataFrame, companies: DataFrame) -> DataFrame:
    """All scores with their place, by priority, intent, fit, name, then ids.

    Scores have one digit, so their priorities are at most 1,001 groups: places are
    counted within a group, and the groups' sizes give where each begins.
    """
    named = scores.join(companies.select("company_id", "name"), "company_id")
    sizes = named.groupBy("priority").agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each priority
    first = sizes.select("priority", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("priority").orderBy(F.desc("intent"), F.desc("fit"), casefold(F.col("name")), "company_id", "service_id")
    return named.join(F.broadcast(first), "priority").withColumn("place", F.col("_first") + F.row_number().over(inside)).drop("_first")


def resolve_params(profiles: DataFrame, column: str = "params", p: Profile = Profile()) -> DataFrame:
    """All parameters of a profile, those of a JSON object over the defaults; all defaults if one is out of range.

    Weights, strengths and tiers are whole or not there at all; reliability and
    half-lives hold what is given, and defaults where nothing is (a half-life of null is
    none). Numbers are columns of their names, the rest maps.
    """
    names = {"tau_intent": p.tau_intent, "tau_risk": p.tau_risk, "fit_exponent": p.fit_exponent, "intent_exponent": p.intent_exponent, "risk_penalty": p.risk_penalty, "min_confidence": p.min_confidence, "max_evidence_per_question": p.max_evidence, "fit_floor": p.fit_floor, "undated_age_days": p.undated_age_days}
    maps = {"weights": p.weights, "strength_values": p.strengths, "reliability": p.reliability, "half_life_days": p.half_life_days, "tiers": {"hot": p.hot, "warm": p.warm}}
    read = F.from_json(column, ", ".join([f"{n} double" for n in names] + [f"{n} map<string,double>" for n in maps]))
    given = {n: F.coalesce(read[n], F.lit(float(v))) for n, v in names.items()}
    fixed = {n: F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, float(v))]) for n, m in maps.items()}
    held = {n: F.coalesce(read[n], fixed[n]) for n in maps}
    whole = [F.sort_array(F.map_keys(held[n])) == F.array(*map(F.lit, sorted(maps[n]))) for n in ("weights", "strength_values", "tiers")]
    ranges = [given["tau_intent"] > 0, given["tau_risk"] > 0, given["fit_exponent"] >= 0, given["intent_exponent"] >= 0, given["risk_penalty"].between(0, 1), given["min_confidence"].between(0, 1), given["max_evidence_per_question"] >= 1, given["fit_floor"] >= 0, given["fit_floor"] < 100, given["undated_age_days"] >= 0]
    ranges += [F.coalesce(held["tiers"]["hot"] >= held["tiers"]["warm"], F.lit(False)), F.forall(F.map_values(held["half_life_days"]), lambda v: v.isNull() | (v > 0))]
    valid = F.lit(True)
    for test in (*whole, *ranges):
        valid = valid & test
    default = {**{n: F.lit(float(v)) for n, v in names.items()}, **fixed}
    return profiles.select("*", valid.alias("valid"), *[F.when(valid, c).otherwise(default[n]).alias(n) for n, c in {**given, **held}.items()])


def temperature_guide(questions: DataFrame, defaults: DataFrame, generic: dict) -> DataFrame:
    """The question's own guide if it has all three levels, else its category's, else the generic one."""
    whole = F.forall(F.array(*[F.try_element_at("temperature", F.lit(k)) for k in ("weak", "moderate", "strong")]), lambda x: x.isNotNull())
    g = F.create_map(*[F.lit(x) for kv in generic.items() for x in kv])
    named = defaults.withColumnRenamed("temperature", "_default")
    return questions.join(F.broadcast(named), "category", "left").withColumn("guide", F.coalesce(F.when(F.coalesce(whole, F.lit(False)), F.col("temperature")), F.col("_default"), g)).drop("_default")


def outreach_text(leads: DataFrame, n: int = 3) -> DataFrame:
    """A text from the top signal, else from the value proposition, and up to three cited ids."""
    top = F.try_element_at("summaries", F.lit(1))
    body = F.when(top.isNotNull(), F.concat(F.lit("We saw that "), F.col("name"), F.lit(": "), top)).otherwise(F.concat(F.lit("We help companies like "), F.col("name"), F.lit(" with "), F.col("value_proposition")))
    return leads.withColumn("outreach", body).withColumn("cited", F.slice("signal_ids", 1, n))
