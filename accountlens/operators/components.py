"""Connected components by rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it is linked with.

    A round has two steps. In the first each node joins its larger neighbours to the
    smallest one it knows, in the second its smaller ones; the paths shorten until
    every node points at its smallest. A node's smallest neighbour is found by partial
    aggregates, so hubs cost no task more than others, and the join that follows has
    one row a node on one side, so that adaptive execution splits what a hub has on
    the other. Each round is a table of its own, and the one before is deleted.
    """
    rounds = Rounds(edges.sparkSession, "components")
    links = rounds.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    for n in range(1, max_rounds + 1):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = rounds.keep(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{n}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        fresh = rounds.keep(small, str(n))
        same = _digest(fresh) == _digest(links)
        links = fresh
        rounds.done(str(n))
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = links.select("b").distinct()
    out = rounds.keep(links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops.select(F.col("b").alias("node"), F.col("b").alias("component"))), "found")
    rounds.done("found")
    return out


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())
