"""Structured Streaming forms of the event operators. Each keeps the batch operator's rows on the same events."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import matches

WATERMARK = "7 days"
LOG = logging.getLogger(__name__)


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def tier_changes(stream: DataFrame) -> DataFrame:
    """Keyed state holds each pair's last tier; scores of a batch are read in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["computed_at", "score_id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.tier != last:
                out.append((*key, r.score_id, last, r.tier, r.computed_at))
            last = r.tier
        state.update((last,))
        yield pd.DataFrame(out, columns=["company_id", "service_id", "score_id", "tier_before", "tier", "computed_at"])

    return stream.groupBy("company_id", "service_id").applyInPandasWithState(
        step, "company_id long, service_id long, score_id long, tier_before string, tier string, computed_at timestamp", "tier string", "append", GroupStateTimeout.NoTimeout
    )


def rule_matches(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream-static; edits of rules hold from the next micro-batch on."""
    return matches(stream, rules)


def jobs_windows(stream: DataFrame, hours: int, least: int, slide: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """Companies with at least so many postings in a sliding window."""
    counted = stream.withWatermark("posted_at", delay).groupBy("company_id", F.window("posted_at", f"{hours} hours", slide)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select("company_id", F.col("window.end").alias("until"), "n")


def digest_slots(stream: DataFrame, slot: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Notifications of each user in tumbling slots."""
    return stream.withWatermark("created_at", delay).groupBy("user_id", F.window("created_at", slot)).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("notification_id")).alias("items")).select("user_id", F.col("window.end").alias("slot"), "n", "items")


def run_tail(stream: DataFrame, after_id: int, delay: str = WATERMARK) -> DataFrame:
    """Events after an id, once each."""
    return stream.where(F.col("id") > after_id).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def fan_out(consumers: dict[str, Callable[[DataFrame], None]], ledger_path: str, attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: at least once to each consumer, tried once in a micro-batch.

    What a consumer failed on is tried again in the micro-batches that follow, with what
    is new there, until its ``attempts`` are used up; then it is given up. The ledger has
    a folder for each micro-batch, with the events that are still owed and those that
    were given up; the one before stays in case the batch is run again, older ones go, so
    its files stay as few. Repeats within the watermark are for the stream to drop.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(ledger_path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(fs_path(ledger_path)) if x.getPath().getName().startswith("v=")) if fs.exists(fs_path(ledger_path)) else []
        before = [v for v in known if v < batch_id]
        fresh = batch.withColumn("consumer", F.explode(F.array(*map(F.lit, consumers)))).withColumn("attempts", F.lit(0)).withColumn("given_up", F.lit(False))
        owed = fresh
        if before:
            held = spark.read.schema(fresh.schema).parquet(f"{ledger_path}/v={before[-1]}")
            owed = held.unionByName(fresh.join(held.select("event_id", "consumer"), ["event_id", "consumer"], "left_anti"))
        failed = []
        for name, consume in consumers.items():
            try:
                consume(owed.where((F.col("consumer") == name) & ~F.col("given_up")).select(*batch.columns))
            except Exception as e:  # tried again in the next micro-batch, as the ledger says
                failed.append(name)
                LOG.warning("consumer %s failed: %s", name, e)
        kept = owed.where(F.col("given_up") | F.col("consumer").isin(failed))
        tried = F.when(F.col("given_up"), F.col("attempts")).otherwise(F.col("attempts") + 1)
        kept = kept.withColumn("attempts", tried).withColumn("given_up", F.col("attempts") >= attempts)
        kept.coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/v={batch_id}")
        for v in before[:-1]:
            fs.delete(fs_path(f"{ledger_path}/v={v}"), True)

    return deliver


def late_rows(batch: DataFrame, column: str, limit) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows before the limit, for a side table)."""
    return batch.where(F.col(column) >= limit), batch.where(F.col(column) < limit)
