"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source's documents, in the order of the hash of their ids, form blocks. With a
target weight w = p / P (whole numbers p that add up to P) the j-th block of a
source is released at slot floor((j - 1) / w) and due before slot ceil(j / w); every
slot takes the released block that is due earliest. Then each source is, after any
number of slots, less than one block away from its share. All sources are exactly
at their shares after P slots, so the schedule repeats: P slots are computed once,
by a fold over the slots, and a block's slot follows from its number by arithmetic.

Documents are numbered without bringing a source together: a bucket of the order
is a range of hashes, buckets are counted, and running sums over two levels of
buckets give each bucket's first number; only a bucket's rows meet in a task.

Defined cases: a null source is a source of its own; null ids order first; repeated
rows are numbered one after the other; a source without a target weight takes none
of the slots and has null block, slot and position; an empty table gives no rows;
other columns stay. Position counts the documents before one in the mixture; slots
that a finished source leaves empty are passed over. ``in_mix`` says whether every
source still had a block to give in all slots so far, so that the shares hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 8
#: Slots of a period: weights are rounded to whole numbers that add up to it.
PERIOD = 1000
BUCKET_DOCS = 4096
#: Up to so many sources their weights and slots are broadcast; beyond, joined by Spark's choice.
BROADCAST_SOURCES = 10_000


def tempered_weights(docs: DataFrame, exponent: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, weight): each source's number of documents to the exponent."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(exponent)).alias("weight"))


def periods(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, rank, p, total): whole numbers in proportion to the weights, at least 1, largest remainders first. total is their sum."""
    everywhere = Window.partitionBy()
    known = weights.where(F.col("weight") > 0)
    share = F.col("weight") / F.sum("weight").over(everywhere) * period
    rounded = known.withColumn("_share", F.round(share, 9)).withColumn("_p", F.greatest(F.lit(1), F.floor("_share")))
    short = F.lit(period) - F.sum("_p").over(everywhere)
    order = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.floor("_share")), F.col("source").asc_nulls_first()))
    whole = rounded.withColumn("p", F.col("_p") + F.when(order <= short, 1).otherwise(0))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first()))
    return whole.select("source", rank.alias("rank"), F.col("p").cast("long").alias("p"), F.sum("p").over(everywhere).cast("long").alias("total"))


def schedule(parts: DataFrame) -> DataFrame:
    """(rank, nth, slot): the slots of one period, by earliest deadline first among the released. parts: from periods()."""
    one = parts.agg(F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("sources"), F.first("total").alias("total"))  # a row for each source

    def step(done: Column, slot: Column) -> Column:
        def candidate(s: Column) -> Column:
            nth = F.element_at(done["counts"], s["rank"].cast("int"))  # blocks of this source so far
            release = F.floor(nth * F.col("total") / s["p"])
            deadline = F.ceil((nth + 1) * F.col("total") / s["p"])
            return F.when((release <= slot) & (nth < s["p"]), F.struct(deadline.alias("deadline"), s["rank"].alias("rank"), (nth + 1).alias("nth")))

        chosen = F.array_min(F.filter(F.transform(F.col("sources"), candidate), lambda c: c.isNotNull()))
        counts = F.transform(done["counts"], lambda c, i: F.when(i + 1 == chosen["rank"], c + 1).otherwise(c))
        taken = F.concat(done["taken"], F.array(F.struct(chosen["rank"].cast("int").alias("rank"), chosen["nth"].alias("nth"), slot.alias("slot"))))
        return F.struct(counts.alias("counts"), taken.alias("taken"))

    start = F.struct(
        F.transform("sources", lambda _: F.lit(0).cast("long")).alias("counts"),
        F.array().cast("array<struct<rank:int,nth:bigint,slot:bigint>>").alias("taken"),
    )
    slots = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    return one.where("total > 0").select(F.aggregate(slots, start, step)["taken"].alias("taken")).select(F.explode("taken").alias("t")).select("t.rank", "t.nth", "t.slot")


def numbered(docs: DataFrame, source_col: str, id_col: str) -> DataFrame:
    """docs with _n: 0, 1, ... within each source by the hash of the id, then the id."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    own = F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), 32)  # rows without an id come first, by the hash of all they have
    hashed = docs.withColumn("_key", F.when(F.col(id_col).isNull(), F.format_string("%016x", own)).otherwise(key))
    hashed = hashed.withColumn("_hash", F.when(F.col(id_col).isNull(), own - F.lit(1 << 32)).otherwise(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")))
    per = math.ceil(docs.count() / BUCKET_DOCS)
    bits = max(2, math.ceil(math.log2(max(per, 1))) + 1)  # the largest source's buckets stay below BUCKET_DOCS
    bits += bits % 2
    bucketed = hashed.withColumn("_bucket", F.shiftright("_hash", 32 - bits)).withColumn("_group", F.shiftright("_bucket", bits // 2))
    counts = bucketed.groupBy(F.col(source_col).alias("_source"), "_group", "_bucket").agg(F.count("*").alias("_rows"))
    groups = counts.groupBy("_source", "_group").agg(F.sum("_rows").alias("_rows"))

    def before(*keys: str) -> Column:
        return F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = groups.select("_source", "_group", before("_source", "_group").alias("_first"))
    inside = counts.select(F.col("_source").alias(source_col), F.col("_group").alias("_g"), "_bucket", before("_source", "_group", "_bucket").alias("_inside"))
    offsets = inside.join(groups, inside[source_col].eqNullSafe(groups["_source"]) & (F.col("_g") == F.col("_group")))
    offsets = offsets.select(source_col, "_bucket", (F.col("_first") + F.col("_inside")).alias("_offset"))
    # A bucket's offset is the first row of its window: the rows are dealt once, and joined with nothing.
    order = Window.partitionBy(source_col, "_bucket").orderBy(F.col("_offset").asc_nulls_last(), "_key", F.col(id_col).asc_nulls_first())
    together = bucketed.drop("_hash", "_group").withColumn("_offset", F.lit(None).cast("long")).withColumn("_row", F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = together.withColumn("_n", F.max("_offset").over(running) + F.row_number().over(order) - 2)
    return ranked.where("_row").select(*docs.columns, "_n")


def mix(docs: DataFrame, weights: DataFrame, block_docs: int = BLOCK_DOCS, period: int = PERIOD, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with block, release, deadline, slot, place and in_mix of every row; (slot, place) is the order of the mixture."""
    parts = periods(weights, period)
    plan = schedule(parts)
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_rows"))
    joined = parts.join(sizes, parts["source"].eqNullSafe(sizes["_source"]), "left")
    blocks = F.floor(F.coalesce("_rows", F.lit(0)) / block_docs)  # whole ones
    slots = plan.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("nth", "slot"))).alias("_slots"))  # at most a period's slots
    spec = joined.join(slots, "rank").select(F.col("source").alias("_source"), "p", "total", blocks.cast("long").alias("_whole"), "_slots")

    def slot_of(block: Column) -> Column:
        """Slot of a source's block 0, 1, ..."""
        turn = F.floor(block / F.col("p"))
        return turn * F.col("total") + F.element_at("_slots", (block - turn * F.col("p") + 1).cast("int"))["slot"]

    spec = spec.withColumn("_ends", slot_of(F.col("_whole")))  # the first slot for which a source has no whole block
    spec = spec.withColumn("_until", F.min("_ends").over(Window.partitionBy()))
    n = numbered(docs, source_col, id_col)
    if weights.count() <= BROADCAST_SOURCES:  # with their slots about as many rows again, or a period
        spec = F.broadcast(spec)
    out = n.join(spec, n[source_col].eqNullSafe(spec["_source"]), "left").withColumn("block", F.when(F.col("p").isNotNull(), F.floor(F.col("_n") / block_docs)))
    out = out.withColumn("slot", slot_of(F.col("block")))
    return out.select(
        *[n[c] for c in docs.columns],
        "block",
        F.floor(F.col("block") * F.col("total") / F.col("p")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("total") / F.col("p")).alias("deadline"),
        "slot",
        F.when(F.col("block").isNotNull(), F.col("_n") - F.col("block") * block_docs).alias("place"),
        F.coalesce(F.col("slot") < F.col("_until"), F.lit(False)).alias("in_mix"),
    )
