"""Dedup, incremental selection, state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds


def collection_dedup(docs: DataFrame, group: str = "company_id", order: str = "ord", url: str = "canonical_url", digest: str = "content_hash") -> DataFrame:
    """In order, a row goes if its URL or hash has been kept. A row that went blocks none after it; of rows equal in all four one stays.

    Rows are settled in rounds over tables: kept is a row before which no undecided one
    has its URL or hash, and then those that share either with it go. A round looks for
    the first of each URL and hash by partial aggregates, so neither a company nor a
    repeated URL is held by a task; there are as many rounds as the longest chain of rows
    that wait for each other. Whole rows are dealt once, at the end.
    """
    rounds = Rounds(docs.sparkSession, "dedup")
    bare = docs.where(F.col(url).isNull() & F.col(digest).isNull())
    some = docs.where(F.col(url).isNotNull() | F.col(digest).isNotNull())
    rank = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col(url).alias("u"), F.col(digest).alias("h"))
    open_ = rounds.keep(some.select(F.col(group).alias("g"), rank.alias("rank"), F.col(url).alias("u"), F.col(digest).alias("h")).distinct(), "open-0")
    kept, n = None, 0
    while kept is None or not open_.isEmpty():
        n += 1
        firsts = [open_.where(F.col(c).isNotNull()).groupBy("g", c).agg(F.min("rank").alias(f"first_{c}")) for c in ("u", "h")]
        known = open_.where("g is not null").join(firsts[0], ["g", "u"], "left").join(firsts[1], ["g", "h"], "left")
        first = F.lit(True)
        for c in ("u", "h"):
            first = first & (F.col(c).isNull() | F.col("rank").eqNullSafe(F.col(f"first_{c}")))
        settled = rounds.keep(known.where(first).select("g", "rank", "u", "h"), f"kept-{n}")
        left = open_
        for c in ("u", "h"):
            left = left.join(settled.select("g", c).where(F.col(c).isNotNull()), ["g", c], "left_anti")
        open_ = rounds.keep(left, f"open-{n}")
        kept = settled if kept is None else kept.unionByName(settled)
        rounds.done(f"open-{n}", *(f"kept-{k}" for k in range(1, n + 1)))
    names = {"g": group, "u": url, "h": digest}
    same = [F.col(f"k.{a}").eqNullSafe(F.col(f"d.{b}")) for a, b in names.items()] + [F.col("k.rank.at").eqNullSafe(F.col(f"d.{order}"))]
    whole = some.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates([group, order, url, digest])
    return whole.unionByName(bare)


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """D02."""
    return docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def snippets(chunks: DataFrame, docs: DataFrame, since: Column, source_types: list[str]) -> DataFrame:
    """Chunks of recent documents of the given sources, in document order."""
    kept = docs.where(F.col("source_type").isin(source_types) & (F.coalesce("published_on", "fetched_on") >= since))
    return chunks.join(kept.drop("text"), "doc_id")


def load_windows(questions: DataFrame, now: Column) -> DataFrame:
    """Since when, and from which sources, each service reads."""
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_types"))))
    return questions.groupBy("service_id").agg(F.date_sub(now, F.max("recency_days")).alias("since"), sources.alias("source_types"))


def fingerprint(chunks: DataFrame, questions: DataFrame, prompt_version: str) -> DataFrame:
    """(company, service, fingerprint) of the chunks and question versions that an extraction reads."""
    q = questions.groupBy("service_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("@", "question_id", "version"))), ",").alias("_q"))
    c = chunks.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("chunk_id").cast("string"))), ",").alias("_c"))
    return c.crossJoin(F.broadcast(q)).select("company_id", "service_id", F.sha2(F.concat_ws("|", "_q", "_c", F.lit(prompt_version)), 256).alias("fingerprint"))  # a row for each service


def changed(fresh: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs whose fingerprint is not the stored one."""
    return fresh.join(state.select("company_id", "service_id", "fingerprint"), ["company_id", "service_id", "fingerprint"], "left_anti")


def upsert(state: DataFrame, fresh: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key, fresh rows over stored ones of the same version."""
    both = state.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_fresh"))
    return both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_fresh")


def supersede(stored: DataFrame, fresh: DataFrame, wrong_keys: DataFrame) -> DataFrame:
    """Stored active or rejected rows of the pairs scored now become superseded; fresh evidence voted incorrect comes back rejected."""
    pairs = fresh.select("company_id", "service_id").distinct().withColumn("_hit", F.lit(True))
    old = stored.join(pairs, ["company_id", "service_id"], "left")
    old = old.withColumn("status", F.when(F.col("_hit") & F.col("status").isin("active", "rejected_by_user"), "superseded").otherwise(F.col("status"))).drop("_hit")
    bad = wrong_keys.select("company_id", "service_id", "evidence_key").distinct().withColumn("_bad", F.lit(True))
    new = fresh.join(bad, ["company_id", "service_id", "evidence_key"], "left")
    new = new.withColumn("status", F.when(F.col("_bad"), "rejected_by_user").otherwise("active")).drop("_bad")
    return old.unionByName(new, allowMissingColumns=True)


def refresh_due(companies: DataFrame, busy_orgs: DataFrame, now: Column, days: int) -> DataFrame:
    """Tracked companies analysed before, but not lately, of organisations without a running refresh."""
    due = companies.where(F.col("is_tracked") & (F.col("last_analyzed_at") < now - F.make_dt_interval(F.lit(days))))
    return due.join(busy_orgs.select("org_id").distinct(), "org_id", "left_anti")


def extraction_batches(questions: DataFrame, limit: int) -> DataFrame:
    """A batch number for each question of a pair: the list is halved until each part's tokens fit. Needs ord and tokens."""

    def halve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        tokens, batch, todo = rows["tokens"].tolist(), [0] * len(rows), [(0, len(rows))]
        n = 0
        while todo:
            a, b = todo.pop()
            if b - a > 1 and sum(tokens[a:b]) > limit:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            else:
                batch[a:b] = [n] * (b - a)
                n += 1
        return rows.assign(batch=batch)

    schema = ", ".join(f"`{c}` {t}" for c, t in questions.dtypes)
    return questions.groupBy("company_id", "service_id").applyInPandas(halve, f"{schema}, batch int")


def collect_plan(questions: DataFrame, most: int = 20) -> DataFrame:
    """What to collect for a service: sources, longest window, topics with English first."""
    topics = F.flatten(F.collect_list(F.concat(F.coalesce(F.try_element_at("keywords", F.lit("en")), F.array().cast("array<string>")), F.flatten(F.map_values(F.map_filter("keywords", lambda k, _: k != "en"))))))
    return questions.groupBy("service_id").agg(F.max("recency_days").alias("days"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_types")))).alias("source_types"), F.slice(F.array_distinct(topics), 1, most).alias("topics"))


def cache_key(prompt_version: Column, system: Column, contents: Column, schema: Column) -> Column:
    """D12."""
    return F.sha2(F.concat_ws("\x1f", prompt_version, system, contents, schema), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored response, misses)."""
    return requests.join(cache.select("key", "response"), "key"), requests.join(cache.select("key"), "key", "left_anti")


def append_new(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose company and content are not stored yet, one of each."""
    key = ["company_id", "content_hash"]
    return docs.dropDuplicates(key).join(existing.select(*key), key, "left_anti")

