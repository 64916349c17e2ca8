"""Streams whose rows are exactly the batch operators' rows: keyed state, event-time timers, and a first state from batch tables.

They need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import novelty_quote
from ..operators.events import TERMINAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOVEL = ["company_id", "service_id", "question_id", "_quote"]


class FirstOfAll(StatefulProcessor):
    """Of each key the row of the least (time, id), once the watermark has passed it, so that none before it can come. Then the key is done for ever; if that row is rejected nothing of the key is said."""

    def __init__(self, columns: list[str], schema, time: str, name: str):
        self.columns, self.schema, self.time, self.name = columns, schema, time, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)
        self.done = handle.getValueState("done", "done boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.done.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).assign(**dict(zip(NOVEL, key, strict=True)))
        if not self.done.exists():
            first = fresh.sort_values([self.time, self.name], kind="stable").iloc[0]
            if self.best.exists():
                held = dict(zip(self.columns, self.best.get(), strict=True))
                self._move(pd.Timestamp(held[self.time]), None)
                if (pd.Timestamp(held[self.time]), held[self.name]) <= (first[self.time], first[self.name]):
                    first = pd.Series(held)
            self.best.update(tuple(_plain(first[c]) for c in self.columns))
            self._move(None, pd.Timestamp(first[self.time]))
        yield pd.DataFrame(columns=self.columns)

    def _move(self, before: pd.Timestamp | None, after: pd.Timestamp | None) -> None:
        if before is not None:
            self.handle.deleteTimer(_millis(before))
        if after is not None:
            self.handle.registerTimer(_millis(after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.best.get()
        self.best.clear()
        self.done.update((True,))
        yield pd.DataFrame([row], columns=self.columns)

    def close(self) -> None:
        pass


class OncePerWindow(StatefulProcessor):
    """Rows of a key that come ``seconds`` or more after the last one that was let through, in order of time and id."""

    def __init__(self, columns: list[str], time: str, name: str, seconds: int):
        self.columns, self.time, self.name, self.seconds = columns, time, name, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((initialState[self.time].max(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values([self.time, self.name], kind="stable")
        last, kept = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None, []
        for at in fresh[self.time]:
            kept.append(last is None or (at - last).total_seconds() >= self.seconds)
            last = at if kept[-1] else last
        if last is not None:
            self.last.update((last.to_pydatetime(),))
        yield fresh[kept][self.columns]

    def close(self) -> None:
        pass


class UntilFinished(StatefulProcessor):
    """Rows of a run, once each, in the order of their ids, up to the first that ends it."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "highest long, finished boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("id", kind="stable").drop_duplicates("id")
        highest, finished = self.state.get() if self.state.exists() else (-1, False)
        fresh = fresh[fresh["id"] > highest]
        if finished:
            fresh = fresh[:0]
        ends = (fresh["stage"] == "run") & fresh["status"].isin(TERMINAL)
        fresh = fresh[ends.cumsum() - ends == 0]  # what comes after the first end does not go out
        if len(fresh):
            self.state.update((int(fresh["id"].max()), finished or bool(ends.any())))
        yield fresh[self.columns]

    def close(self) -> None:
        pass


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def _millis(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


def new_signals(stream: DataFrame, seen: DataFrame, delay: str) -> DataFrame:
    """The rows of the batch operator: of each company, service, question and quote the first ever, unless it is rejected or among ``seen``. A row goes out when no earlier one can come any more."""
    rows = stream.withColumn("_quote", novelty_quote(F.col("quote"))).withWatermark("detected_at", delay)
    known = seen.withColumn("_quote", novelty_quote(F.col("quote"))).select(*NOVEL).distinct()
    processor = FirstOfAll(rows.columns, rows.schema, "detected_at", "signal_id")
    first = rows.groupBy(*NOVEL).transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="EventTime", initialState=known.groupBy(*NOVEL))
    return first.where("status <> 'rejected_by_user'").drop("_quote")


def once_per_window(stream: DataFrame, notified: DataFrame, seconds: int, delay: str) -> DataFrame:
    """Notifications (rule_id, company_id, notified_at, notification_id) that no other of the pair went out for in the seconds before; ``notified``: those of before the stream."""
    rows = stream.withWatermark("notified_at", delay)
    keys = ["rule_id", "company_id"]
    processor = OncePerWindow(rows.columns, "notified_at", "notification_id", seconds)
    before = notified.select(*keys, "notified_at").groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="EventTime", initialState=before)


def run_tail(stream: DataFrame, after_id: int) -> DataFrame:
    """A run's events after an id, once each, up to the one that ends it."""
    rows = stream.where(F.col("id") > after_id)
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=UntilFinished(rows.columns), outputStructType=rows.schema, outputMode="Append", timeMode="None")
