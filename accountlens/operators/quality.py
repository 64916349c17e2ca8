"""Votes, precision, evaluation and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_votes(votes: DataFrame) -> DataFrame:
    """Q01: one vote a user and target, the last version; withdrawn ones (verdict null) go."""
    key = ["user_id", "target_type", "target_id"]
    return votes.groupBy(*key).agg(F.max_by(F.struct("verdict", "version"), "version").alias("v")).select(*key, "v.verdict", "v.version").where("verdict is not null")


def reject_by_votes(signals: DataFrame, votes: DataFrame) -> DataFrame:
    """Q02: an "incorrect" vote on any row of a company, service and evidence rejects all of them; superseded rows stay."""
    key = ["company_id", "service_id", "evidence_key"]
    wrong = votes.where("verdict = 'incorrect'").select(F.col("target_id").alias("signal_id")).distinct()
    bad = signals.join(wrong, "signal_id", "left_semi").select(*key).distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("status") == "superseded", F.col("status")).when(F.col("_bad"), "rejected_by_user").otherwise("active")
    return signals.join(bad, key, "left").withColumn("status", status).drop("_bad")


def affected_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q03: pairs with a signal whose status changed; these are to be scored again."""
    old = before.select("signal_id", F.col("status").alias("_old"))
    return after.join(old, "signal_id").where("status <> _old").select("company_id", "service_id").distinct()


def precision(votes: DataFrame, signals: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Q04: correct, labelled and precision by category, by source, and overall, in one pass over grouping sets."""
    rows = votes.where("target_type = 'signal'").join(signals, votes["target_id"] == signals["signal_id"])
    source = F.col("source_type")
    if documents is not None:
        rows = rows.join(documents.select(F.col("doc_id").alias("document_id"), F.col("source_type").alias("_doc_source")), "document_id", "left")
        source = F.coalesce("_doc_source", "source_type")
    rows = rows.select("category", source.alias("source"), (F.col("verdict") == "correct").cast("int").alias("ok"))
    sums = rows.groupingSets([["category"], ["source"], []], "category", "source").agg(
        F.expr("case grouping_id(category, source) when 1 then 'category' when 2 then 'source' else 'all' end").alias("level"), F.sum("ok").alias("correct"), F.count("*").alias("labelled")
    )
    return sums.select("level", F.coalesce("category", "source").alias("name"), "correct", "labelled", F.coalesce(F.bround(F.try_divide("correct", "labelled"), 2), F.lit(0.0)).alias("precision"))


def lead_votes(votes: DataFrame) -> DataFrame:
    """Q05."""
    return votes.where("target_type = 'lead'").groupBy("verdict").agg(F.count("*").alias("n"))


def verifier_stats(signals: DataFrame, rejected: DataFrame) -> DataFrame:
    """Q06: rejections by reason, and the share of quotes that were not found among all evidence."""
    total = signals.agg(F.count("*").alias("n_signals"))
    r = rejected.agg(F.count("*").alias("n_rejected"), F.count_if(F.col("reason") == "quote_not_found").alias("not_found"))
    one = total.crossJoin(r)  # a row each
    return one.withColumn("hallucination", F.coalesce(F.bround(F.try_divide("not_found", F.col("n_signals") + F.col("n_rejected")), 4), F.lit(0.0)))


def rejects_by_reason(rejected: DataFrame) -> DataFrame:
    """Q06."""
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def confusion(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Q07: tp, fp, fn, tn, precision, recall and f1: overall, and by each of the columns. decisions: expected, answer."""
    d = decisions.where(F.coalesce(F.col("answer") != "not_evaluated", F.lit(True)))
    yes, want = F.coalesce(F.col("answer") == "yes", F.lit(False)), F.col("expected") == "yes"
    counts = [F.count_if(want & yes).alias("tp"), F.count_if(~want & yes).alias("fp"), F.count_if(want & ~yes).alias("fn"), F.count_if(~want & ~yes).alias("tn")]
    out = d.groupingSets([*[[c] for c in by], []], *by).agg(F.grouping_id(*by).alias("level"), *counts)
    p, r = (F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def abstention(decisions: DataFrame, rejected: DataFrame) -> DataFrame:
    """Q08: share of answers that are unclear, and of rejected evidence (but for missing evidence) whose quote was not found."""
    a = decisions.agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "unclear").alias("unclear"))
    b = rejected.where("reason <> 'no_evidence_for_yes'").agg(F.count("*").alias("n_rejected"), F.count_if(F.col("reason") == "quote_not_found").alias("not_found"))
    return a.crossJoin(b).withColumn("abstention", F.coalesce(F.try_divide("unclear", "n"), F.lit(0.0)))  # a row each


def label_outcomes(labels: DataFrame, outcomes: DataFrame, signals: DataFrame, normal) -> DataFrame:
    """Q09: labels with answer, whether a signal carries the labelled quote (either holds the other), and traps that leaked."""
    key = ["company_id", "question_id"]
    carried = labels.join(signals.select(*key, "quote"), key).withColumn("a", normal(F.col("hint"))).withColumn("b", normal(F.col("quote")))
    carried = carried.groupBy(*key).agg(F.bool_or(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).alias("carried"))
    out = labels.join(outcomes, key, "left").join(carried, key, "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
    return out.withColumn("leaked", (F.col("expected") == "trap") & F.col("carried"))


def label_problems(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """Q10: labels that repeat a company, service and question, and labels of unknown questions."""
    twice = labels.groupBy("domain", "service", "question_key").agg(F.count("*").alias("n")).where("n > 1").select("domain", "service", "question_key", F.lit("duplicate").alias("problem"))
    unknown = labels.join(keys, ["service", "question_key"], "left_anti").select("domain", "service", "question_key", F.lit("unknown question").alias("problem"))
    return twice.unionByName(unknown.distinct())


def quota_day(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """Q11: the day in the zone of the quota, of a time in UTC."""
    return F.from_utc_timestamp(at, zone).cast("date")


def usage(calls: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Q11: by quota day and model: calls, those that use the quota, cache hits, errors, tokens, and what remains."""
    counted = ~F.col("cache_hit") & (F.col("status") != "rate_limited")
    out = calls.groupBy(quota_day(F.col("created_at")).alias("day"), "model").agg(
        F.count("*").alias("calls"), F.count_if(counted).alias("quota_calls"), F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(F.col("status") == "error").alias("errors"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
    )
    if limits is None:
        return out
    return out.join(F.broadcast(limits), "model", "left").withColumn("remaining", F.greatest(F.lit(0), F.col("day_limit") - F.col("quota_calls")))


def documents_scanned(docs: DataFrame, since: Column, until: Column) -> DataFrame:
    """Q12."""
    return docs.where((F.col("published_on") >= since) & (F.col("published_on") < until)).groupBy("source_type").agg(F.count("*").alias("n"))


def last_per_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_nth = 1").drop("_nth")
