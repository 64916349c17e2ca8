"""Exact top-k search by inner product, with MaxScore over shards.

Vectors become whole numbers, floor(scale * x). A dimension is a query term and its
column of a shard the posting list, in blocks of ``POSTINGS`` vectors with the
largest and the smallest value of each. A term's bound for a query is the largest
product that any vector of the shard can add, and its floor the smallest. Blocks
are visited in the order of their own bounds, those that cannot reach the query's
k-th best score so far are passed over. For each query and step the terms are
split: the non-essential ones are as many of the smallest spreads (bound less
floor) as leave a vector that has only these below that score; the postings of the
essential ones are traversed, and the others are probed, largest spread first, for
vectors that are still competitive. Every scored vector raises the score to beat.
Shards return k candidates a query, which a window merges.

Queries meet candidates in blocks: a shard of at most about ``SHARD`` vectors and a
block of at most about ``QUERIES`` queries are one task's group, so a group's size
is bounded whatever the table's size.

Defined cases: null vectors and vectors with null or non-finite components take no
part, nor do components too large for a long; vectors of different lengths do not
meet; ties go to the smaller id; rows that repeat an id are candidates each, and
the least of their vectors is the query; empty vectors score 0; scores beyond a
long are its ends; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, QUERIES = 8192, 16_384
#: Vectors in a block of postings, blocks visited at a time, and terms probed at a time.
POSTINGS, STEP, PROBES = 32, 16, 8
#: Whole numbers below this are exact in a double.
EXACT = 2**53


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<long>) of the rows whose components are all finite."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < F.lit(2.0**62)))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def matrix(table: pa.Table) -> np.ndarray:
    n = table.num_rows
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def coherent(vectors: np.ndarray) -> np.ndarray:
    """An order in which like vectors stand together, so that the blocks' bounds are tight: halves along the widest dimension, again and again."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        some = todo.pop()
        if len(some) <= POSTINGS or not vectors.shape[1]:
            out.append(some)
            continue
        held = vectors[some]
        widest = int((held.max(axis=0) - held.min(axis=0)).argmax())
        half = len(some) // (2 * POSTINGS) * POSTINGS or POSTINGS
        parts = np.argpartition(held[:, widest], half)
        todo += [some[parts[half:]], some[parts[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Shard:
    """Postings of a shard's vectors. ``read`` counts the postings that searches traversed or probed."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, largest_query: int):
        exact = float(np.abs(vectors).max(initial=0)) * float(largest_query) * max(1, vectors.shape[1]) < EXACT
        self.kind = np.float64 if exact else object  # whole numbers of any size, where a double is too short
        self.order = coherent(vectors)
        self.ids = ids[self.order]
        self.columns = np.ascontiguousarray(vectors[self.order].T).astype(self.kind)
        self.starts = np.arange(0, len(ids), POSTINGS)
        self.high = np.maximum.reduceat(self.columns, self.starts, axis=1)
        self.low = np.minimum.reduceat(self.columns, self.starts, axis=1)
        self.read = 0

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best vectors, ties to the smaller id; those of the query's own id are left out."""
        q = query.astype(self.kind)
        best, worst = np.maximum(q[:, None] * self.high, q[:, None] * self.low), np.minimum(q[:, None] * self.high, q[:, None] * self.low)
        bound = best.sum(axis=0)  # of each block
        top, floor = best.max(axis=1), worst.min(axis=1)  # of each term
        terms = np.argsort(-(top - floor).astype(np.float64), kind="stable")
        after = np.append(np.cumsum(top[terms][::-1])[::-1], 0)  # what the terms from a place on can add
        spread = np.append(np.cumsum((top - floor)[terms][::-1])[::-1], 0)
        visit = np.argsort(-bound.astype(np.float64), kind="stable")
        places, scores = np.zeros(0, np.int64), np.zeros(0, self.kind)
        beat = None  # the k-th best score so far
        for a in range(0, len(visit), STEP):
            some = visit[a : a + STEP]
            if beat is not None:
                some = some[bound[some] >= beat]
                if not len(some):
                    break  # the blocks that follow have smaller bounds
            at = (self.starts[some][:, None] + np.arange(POSTINGS)).ravel()
            at = at[at < len(self.ids)]
            at = at[self.ids[at] != own]
            # The first place from which all terms together lift no vector from the floor of all to the score to beat.
            cut = len(terms) if beat is None else int(np.argmax(spread < beat - floor.sum())) if (spread < beat - floor.sum()).any() else len(terms)
            essential = terms[:cut]
            partial = q[essential] @ self.columns[np.ix_(essential, at)] if len(essential) else np.zeros(len(at), self.kind)
            self.read += len(essential) * len(at)
            while cut < len(terms):
                stay = partial + after[cut] >= beat
                at, partial = at[stay], partial[stay]
                if not len(at):
                    break
                probed = terms[cut : cut + PROBES]
                partial = partial + q[probed] @ self.columns[np.ix_(probed, at)]
                self.read += len(probed) * len(at)
                cut += len(probed)
            places, scores = np.append(places, at), np.append(scores, partial)
            ranked = np.lexsort((self.ids[places], -scores))[:k]
            places, scores = places[ranked], scores[ranked]
            if len(places) == k:
                beat = scores[-1]
        return self.order[places], np.clip(scores, -(2**63), 2**63 - 1) if self.kind is object else scores


def best_of_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best of a shard, its own id left out."""
    shard = Shard(vectors, ids, int(np.abs(queries).max(initial=0)))
    found = [shard.search(q, own, k) for q, own in zip(queries, query_ids.tolist(), strict=True)]
    rows = np.repeat(np.arange(len(found)), [len(places) for places, _ in found])
    return rows, np.concatenate([places for places, _ in found]), np.concatenate([s for _, s in found]).astype(np.int64)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own."""
    vectors = quantised(df, id_col, vector_col, scale)
    is_query = F.col("id") % every == 0
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n_queries / QUERIES))
    dim = F.size("v").alias("dim")
    mine = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard")
    candidates = vectors.select("id", "v", dim, mine, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", dim, block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        qid, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        r, c, s = best_of_shard(matrix(left), qid, matrix(right), ids, k)
        return pa.table([qid[r], ids[c], s], schema=out)

    keys = ["shard", "block", "dim"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
