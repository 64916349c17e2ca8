"""Clusters of signals of one event (K01-K04), without pairs of all signals of a question.

Two signals of a question are one event if their dates are near or missing, the numbers
of one are among the other's, and their quotes or summaries are alike (K01-K03). What
is linked together is a cluster (K04). Texts are folded once a signal. Signals that say
the same with the same numbers are runs of near days; a run meets others as one row.
Runs are compared in blocks: counts of letters bound the ratio of whole texts, hashed
words that of contained ones, and only pairs within both bounds are measured. A block
sends on a forest of links, never its pairs.

Questions of up to GROUP signals are settled in a task that holds them; larger ones are
dealt in blocks over the cluster and joined by components(). Both give the same clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbers
from ..storage import Rounds
from .components import components
from .verify import folded_words, token_set_ratio, token_sort_ratio

#: Signals of a question that a task settles alone, runs of a block, and rows below which pairs are looked at one by one.
GROUP, BLOCK, FEW = 1024, 512, 12
# Least ratio of the sorted words, least ratio of the sets of words and the words that a text then needs.
SORTED_RATIO, SET_RATIO, SET_WORDS = 82.0, 95.0, 5
_WORD_BITS = 256
_LOOSE = -(10**8)


@lru_cache(maxsize=1 << 16)
def folded(text: str | None) -> str:
    return folded_words(text)


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str) -> bool:
    if token_sort_ratio(a, b) >= SORTED_RATIO:
        return True
    return min(a.count(" "), b.count(" ")) + 1 >= SET_WORDS and token_set_ratio(a, b) >= SET_RATIO


def alike(a: str, b: str) -> bool:
    """K03, of folded texts. Equal ones are alike, empty ones like nothing."""
    if not a or not b:
        return False
    return a == b or (_alike(a, b) if a < b else _alike(b, a))


class Union:
    """Sets of numbers; the smallest is the name of its set."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


class Runs(NamedTuple):
    """Rows that say a text with some numbers from one day to another, no gap being over the limit; loose ones have a member without a date."""

    node: list[int]
    text: list[str]
    numbers: list[frozenset]
    low: np.ndarray
    high: np.ndarray
    loose: np.ndarray


class Shapes(NamedTuple):
    """What bounds the ratios of texts: counts of letters and lengths of all words and of the different ones, and hashed words."""

    letters: np.ndarray
    size: np.ndarray
    set_letters: np.ndarray
    set_size: np.ndarray
    words: np.ndarray
    many: np.ndarray


def shapes(texts: list[str]) -> Shapes:
    def letters(some: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(some).encode("ascii"), np.uint8)
        kind = np.where(codes >= 97, codes - 97, np.where(codes >= 48, codes - 22, 36)).astype(np.int64)
        owner = np.repeat(np.arange(len(some)), [len(x) for x in some])
        return np.bincount(owner * 37 + kind, minlength=len(some) * 37).reshape(-1, 37).astype(np.int32)

    split = [t.split() for t in texts]
    sets = [" ".join(dict.fromkeys(w)) for w in split]
    bits = np.zeros((len(texts), _WORD_BITS), np.uint8)
    for i, words in enumerate(split):
        bits[i, [hash_word(w) for w in words]] = 1
    count = lambda x: np.array([len(t) for t in x], np.int64)
    return Shapes(letters(texts), count(texts), letters(sets), count(sets), np.packbits(bits, axis=1).view(np.uint64), np.array([len(w) for w in split]) >= SET_WORDS)


@lru_cache(maxsize=1 << 16)
def hash_word(word: str) -> int:
    return int.from_bytes(word.encode()[:8], "little") * 0x9E3779B97F4A7C15 % (1 << 64) >> 56


def possible(i: int, one: Shapes, two: Shapes) -> np.ndarray:
    """Which texts of the second block could be like the i-th of the first."""
    total = one.size[i] + two.size
    # Insertions and deletions are at least the difference in letters. A ratio r allows (1 - r) of both lengths.
    out = np.abs(one.letters[i] - two.letters).sum(1) <= (1 - SORTED_RATIO / 100) * total + 1e-6
    if one.many[i]:
        share = 1 - SET_RATIO / 100
        near = np.abs(one.set_letters[i] - two.set_letters).sum(1) <= share * (one.set_size[i] + two.set_size) + 2
        # Or one text lacks words of at most 2 * share of its letters, each of one letter and a space or more.
        lacks = lambda x, y, size: np.bitwise_count(x & ~y).sum(1) <= share * size + 1
        inside = lacks(one.words[i], two.words, one.set_size[i]) | lacks(two.words, one.words[i], two.set_size)
        out |= two.many & (near | inside)
    return out


def forest(one: Runs, two: Runs, days: int, union: Union, itself: bool) -> list[tuple[int, int]]:
    """Links between runs that are one event, only those that join two sets."""
    left = shapes(one.text)
    right = left if itself else shapes(two.text)
    out = []
    for i in range(len(one.node)):
        near = (one.loose[i] | two.loose | ((two.low <= one.high[i] + days) & (two.high >= one.low[i] - days))) & possible(i, left, right)
        for j in np.flatnonzero(near[i + 1 :] if itself else near).tolist():
            j += i + 1 if itself else 0
            a, b = one.node[i], two.node[j]
            x, y = one.numbers[i], two.numbers[j]
            if union.root(a) != union.root(b) and (x <= y or y <= x) and alike(one.text[i], two.text[j]):
                union.join(a, b)
                out.append((a, b))
    return out


def runs_of(texts: list[str], numbers_: list[frozenset], dates: list[int | None], days: int, union: Union) -> Runs:
    """Runs of rows with a text; the rows of a run are joined."""
    groups: dict = {}
    for i, key in enumerate(zip(texts, numbers_, strict=True)):
        if key[0]:
            groups.setdefault(key, []).append(i)
    rows = []
    for (text, n), members in groups.items():
        loose = any(dates[i] is None for i in members)
        members.sort(key=lambda i: (dates[i] is None, dates[i] or 0))
        start = 0
        for k in range(1, len(members) + 1):
            if k < len(members) and (loose or dates[members[k]] - dates[members[k - 1]] <= days):
                union.join(members[start], members[k])
                continue
            known = [dates[i] for i in members[start:k] if dates[i] is not None]
            rows.append((members[start], text, n, min(known, default=0), max(known, default=0), loose))
            start = k
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return Runs(list(columns[0]), list(columns[1]), list(columns[2]), *(np.array(c, np.int64) for c in columns[3:5]), np.array(columns[5], bool))


def settle(dates: list, quotes: list[str], summaries: list[str], numbers_: list[frozenset], twins: list) -> list[int]:
    """Of each signal of a question the smallest place that it is linked with. Texts are folded."""
    n, days = len(dates), 14
    union = Union(n)
    first: dict = {}
    for i, t in enumerate(twins):
        if t is not None:
            union.join(first.setdefault(t, i), i)
    if n <= FEW:
        for i in range(n):
            for j in range(i + 1, n):
                if dates[i] is not None and dates[j] is not None and abs(dates[i] - dates[j]) > days or union.root(i) == union.root(j):
                    continue
                x, y = numbers_[i], numbers_[j]
                if (x <= y or y <= x) and (alike(quotes[i], quotes[j]) or alike(summaries[i], summaries[j])):
                    union.join(i, j)
    else:
        for texts in (quotes, summaries):
            runs = runs_of(texts, numbers_, dates, days, union)
            forest(runs, runs, days, union, True)
    return [union.root(i) for i in range(n)]


def _prepared(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with _g, their question as one string, _day, _nums, and _twin, equal for signals that are one event by their source."""
    twin = F.lit(None).cast("string")
    if {"document_id", "source_key"} <= set(signals.columns):
        twin = F.concat("source_key", F.lit("\x1f"), F.col("document_id").cast("string"), F.lit("\x1f"), "quote")
    nums = F.array_sort(numbers(F.concat_ws(" ", "quote", "summary")))
    return signals.withColumns({"_g": F.to_json(F.struct(*keys)), "_day": F.unix_date("date"), "_nums": nums, "_twin": twin})


def _settled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with cluster, questions whole in a task."""

    def solve(table: pa.Table, bounds: np.ndarray) -> pa.Array:
        ids = table.column("signal_id").to_pylist()
        cluster = list(ids)
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes > 1)
        if len(some):
            dates, quotes, summaries, nums, twins = (table.column(c).to_pylist() for c in ("_day", "quote", "summary", "_nums", "_twin"))
            for a, b in zip(bounds[some].tolist(), bounds[some + 1].tolist(), strict=True):
                order = sorted(range(a, b), key=ids.__getitem__)
                found = settle([dates[i] for i in order], [folded(quotes[i]) for i in order], [folded(summaries[i]) for i in order], [frozenset(nums[i] or ()) for i in order], [twins[i] for i in order])
                for i, root in zip(order, found, strict=True):
                    cluster[i] = ids[order[root]]
        return pa.array(cluster, table.schema.field("signal_id").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            g = held.column("_g").to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            if len(starts) > 1:
                yield from out(held.slice(0, int(starts[-1])), starts)
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield from out(held, np.array([0, held.num_rows]))

    def out(table: pa.Table, bounds: np.ndarray) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        return table.select(columns).append_column("cluster", solve(table, bounds)).to_batches()

    schema = rows.select(*columns, F.col("signal_id").alias("cluster")).schema
    return rows.repartition("_g").sortWithinPartitions("_g").mapInArrow(run, schema)


def _stars(rows: DataFrame, same: list[str]) -> DataFrame:
    """(a, b): each signal linked with the first that has the same values."""
    first = rows.groupBy(*same).agg(F.min("signal_id").alias("b"))
    return rows.join(first, same).select(F.col("signal_id").alias("a"), "b").where("a <> b")


def _spread(rows: DataFrame, days: int) -> DataFrame:
    """(node, component) of the signals of large questions that are linked with others."""
    spark = rows.sparkSession
    rounds = Rounds(spark, "clusters")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pa.array([folded(t) for t in batch.column(c).to_pylist()], pa.string()) for c in ("quote", "summary")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_g", "signal_id", "_day", "_nums", "_twin")), *texts], ["_g", "signal_id", "_day", "_nums", "_twin", "q", "s"])

    kind = rows.schema["signal_id"].dataType.simpleString()
    columns = rows.select("_g", "signal_id", F.coalesce("_day", F.lit(_LOOSE)).alias("_day"), "_nums", "_twin", "quote", "summary")
    base = rounds.keep(columns.mapInArrow(fold, f"_g string, signal_id {kind}, _day int, _nums array<string>, _twin string, q string, s string"), "base")
    edges, runs = _stars(base.where("_twin is not null"), ["_g", "_twin"]), None
    for text in ("q", "s"):
        said = base.where(F.col(text) != "").withColumn("text", F.col(text))
        what = ["_g", "text", "_nums"]
        edges = edges.unionAll(_stars(said, [*what, "_day"]))
        # A row for each day on which a text is said, so a text that is everywhere is as long as the calendar.
        per_day = said.groupBy(*what, "_day").agg(F.min("signal_id").alias("node"))
        one, order = Window.partitionBy(*what), Window.partitionBy(*what).orderBy("_day")
        marked = per_day.withColumn("loose", F.min("_day").over(one) == _LOOSE).withColumn("_gap", F.coalesce(F.col("_day") - F.lag("_day").over(order) > days, F.lit(False)))
        marked = marked.withColumn("_run", F.when(F.col("loose"), 0).otherwise(F.sum(F.col("_gap").cast("int")).over(order)))
        dated = F.when(F.col("_day") != _LOOSE, F.col("_day"))
        found = rounds.keep(marked.groupBy(*what, "_run").agg(F.min("node").alias("node"), F.collect_list("node").alias("_nodes"), F.coalesce(F.min(dated), F.lit(0)).alias("low"), F.coalesce(F.max(dated), F.lit(0)).alias("high"), F.first("loose").alias("loose")).withColumn("kind", F.lit(text)), f"runs-{text}")
        edges = edges.unionAll(found.select(F.explode("_nodes").alias("a"), F.col("node").alias("b")).where("a <> b"))
        runs = found if runs is None else runs.unionAll(found)
    linked = rounds.keep(edges.unionAll(_forests(runs.select("_g", "kind", "node", "text", "_nums", "low", "high", "loose"), days, kind)), "links")
    out = components(linked)
    rounds.done()
    return out


def _forests(runs: DataFrame, days: int, kind: str) -> DataFrame:
    """(a, b): links of each pair of blocks of runs of a question."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                itself = row["i"] == row["j"]
                names: list = []
                blocks = []
                for side in (row["one"],) if itself else (row["one"], row["two"]):
                    blocks.append(Runs([*range(len(names), len(names) + len(side))], [r["text"] for r in side], [frozenset(r["_nums"]) for r in side], *(np.array([r[c] for r in side], np.int64) for c in ("low", "high")), np.array([r["loose"] for r in side], bool)))
                    names += [r["node"] for r in side]
                found = forest(blocks[0], blocks[-1], days, Union(len(names)), itself)
                if found:
                    yield pa.RecordBatch.from_pylist([{"a": names[a], "b": names[b]} for a, b in found], pa.schema([("a", batch.schema.field("one").type.value_type.field("node").type), ("b", batch.schema.field("one").type.value_type.field("node").type)]))

    sizes = runs.groupBy("_g", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = runs.join(sizes, ["_g", "kind"]).withColumn("i", F.pmod(F.xxhash64("node"), "_n"))
    blocks = dealt.groupBy("_g", "kind", "_n", "i").agg(F.collect_list(F.struct("node", "text", "_nums", "low", "high", "loose")).alias("one"))
    left = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).where("i <= j")
    both = left.join(blocks.select("_g", "kind", F.col("i").alias("j"), F.col("one").alias("two")), ["_g", "kind", "j"])
    return both.select("i", "j", "one", F.when(F.col("i") != F.col("j"), F.col("two")).alias("two")).mapInArrow(meet, f"a {kind}, b {kind}")


def event_clusters(signals: DataFrame, keys: list[str], days: int = 14) -> DataFrame:
    """Signals with cluster, the smallest id of what they are linked with. Needs signal_id, date, quote, summary; document_id and source_key tell reprints of one document."""
    rows = _prepared(signals, keys)
    large = rows.groupBy("_g").count().where(F.col("count") > GROUP).select("_g")
    if large.isEmpty():
        return _settled(rows, signals.columns)
    few = _settled(rows.join(large, "_g", "left_anti"), signals.columns)
    many = rows.join(large, "_g", "left_semi")
    named = signals.join(_spread(many, days).withColumnRenamed("node", "signal_id"), "signal_id").withColumn("cluster", F.col("component"))
    alone = many.join(named.select("signal_id"), "signal_id", "left_anti").withColumn("cluster", F.col("signal_id"))
    return few.unionByName(named.select(*signals.columns, "cluster")).unionByName(alone.select(*signals.columns, "cluster"))
