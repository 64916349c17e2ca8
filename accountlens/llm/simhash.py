"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Fingerprints: a bit is 1 where it is set in over half the hashes of a text's word
shingles. Equal fingerprints are one node, so exact copies, however many, cost
one. Nodes are dealt to shards by bands: two fingerprints within ``radius`` bits
agree in at least one of ``radius + 1`` bands, so each pair within the radius meets
in a shard. A shard larger than ``SHARD`` is dealt anew by bands of the remaining
bits, in which the same holds, again and again. Every shard builds a BK-tree, children
keyed by the Hamming distance to their parent, and a lookup follows only edges
within the radius of its own distance. What a shard sends on is a spanning forest
of its links, never its pairs. Components come from alternating large-star and
small-star rounds, each a table of its own.

The trees stand where their shard's rows are: all trees together are as large as
the corpus' fingerprints, so they are neither broadcast nor brought to the driver.

Defined cases: null and empty texts, and texts without a word, have fingerprint 0
and link like any other; a text of fewer words than a shingle is one shingle;
repeated rows and ties are one node, the smallest id names the component; null ids
take no part in naming, and their rows get the component of their fingerprint
(null if all its ids are null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds
from .batches import bounded, map_texts
from .storage import discard, new_path, shuffles_removed, written

#: Fingerprints in a shard before it is dealt anew by further bands.
SHARD = 2048
#: Rows of a key from which it is joined by broadcast, and keys that may be.
HOT_ROWS, HOT_KEYS = 2048, 50_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hash of each shingle, repeats included; none of a text without a word. bytes.split() splits at runs of 0x20 and 0x09 to 0x0D."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits that are set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    each = hashes.view(np.uint8).reshape(n, 8)
    if n > 512:
        ones = np.concatenate([np.bincount(each[:, j], minlength=256) @ _BITS for j in range(8)])
    else:
        ones = np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""

    def run(texts: list) -> list:
        return [np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, run, "fp long")


class BKTree:
    """Distinct integers; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        """Number of the new node."""
        k = len(self.value)
        self.value.append(x)
        self.children.append({})
        at = 0
        while k:
            d = (x ^ self.value[at]).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = k
                break
            at = below
        return k

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius; only edges that can lead there are followed."""
        todo = [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= radius:
                yield at
            for edge, below in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(below)


def _bands(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n parts, as even as possible."""
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _wider(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` bands of its free bits; itself if these are too few."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in band) for band in _bands(free, radius + 1)] if len(free) > radius else [mask]


def shard_forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(position, position of an earlier or root node) links that join what the radius joins, among distinct values."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree = BKTree()
    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(x)
    for i in range(len(values)):
        if (r := root(i)) != i:
            yield i, r


def links(nodes: DataFrame, radius: int = 3, path: str | None = None) -> DataFrame:
    """(a, b), written: pairs of node ids, a > b, whose components are those of all pairs within the radius. nodes: (node, fp), fp distinct.

    A shard is a mask of bits and their values. Shards of more than ``SHARD`` rows
    are dealt anew by bands of their free bits, all of them in one exchange a level,
    so that no task gets a crowded one.
    """
    masks, keyed, settled = _wider(0, radius), None, []
    rounds = Rounds(nodes.sparkSession, "shards")
    at = nodes.select("node", "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    while True:
        keyed = at.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        splits = {m: _wider(m, radius) for m in masks}
        open_masks = [_signed(m) for m, w in splits.items() if w != [m]]
        crowded = rounds.keep(keyed.groupBy("mask", "bits").count().where((F.col("count") > SHARD) & F.col("mask").isin(open_masks)).select("mask", "bits"), f"crowded-{len(settled)}")
        if not crowded.take(1):
            settled.append(keyed)
            break
        settled.append(keyed.join(crowded, ["mask", "bits"], "left_anti"))
        further = F.coalesce(*(F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)) for x in w))) for m, w in splits.items()))
        at = keyed.join(crowded, ["mask", "bits"], "left_semi").select("node", "fp", F.explode(further).alias("mask"))
        masks = sorted({x for w in splits.values() for x in w})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values = None, [], []
        found: tuple[list, list] = ([], [])

        def flush() -> None:
            if len(ids) > 1:
                for i, j in shard_forest(values, radius):
                    found[0].append(max(ids[i], ids[j]))
                    found[1].append(min(ids[i], ids[j]))
            ids.clear(), values.clear()

        for batch in batches:
            for mask, bits, node, fp in zip(*(batch.column(c).to_pylist() for c in ("mask", "bits", "node", "fp")), strict=True):
                if (mask, bits) != at:
                    flush()
                    at = (mask, bits)
                ids.append(node)
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])
                found = ([], [])
        flush()
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    dealt = reduce(DataFrame.unionByName, settled).repartition("mask", "bits").sortWithinPartitions("mask", "bits", "node")
    out = written(dealt.select("mask", "bits", "node", "fp").mapInArrow(run, "a long, b long").distinct(), "links", path)
    rounds.done()
    return out


def with_hot(rows: DataFrame, facts: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with the one row of ``facts`` (key, ..., _rows) of their key, without _rows.

    Keys of many rows are joined by broadcast, so that their rows stay where they are:
    with over n_rows / HOT_KEYS rows each, there are fewer than HOT_KEYS of them.
    """
    hot = F.col("_rows") > max(HOT_ROWS, n_rows // HOT_KEYS)
    few = F.broadcast(facts.where(hot).drop("_rows"))
    rest = facts.where(~hot).drop("_rows")
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def components(edges: DataFrame, max_rounds: int = 64, path: str | None = None) -> DataFrame:
    """(node, component), written, for every node of the edges (a, b): the smallest node it is joined with.

    Large-star joins a node's larger neighbours to its smallest one, small-star its
    smaller neighbours; rounds alternate until nothing changes. Each is a table, and the
    one before goes when it stands.
    """
    rounds = Rounds(edges.sparkSession, "rounds")
    edges = rounds.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

    before = summary(edges)
    for k in range(max_rounds if before[0] else 0):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_rows"))
        large = with_hot(both, least, "a", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = rounds.keep(large, f"large-{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows"))
        small = with_hot(large, low, "a", 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = rounds.keep(small.where("a <> b").distinct(), f"small-{k}")
        rounds.done(f"small-{k}")
        now = summary(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = written(named, "components", path)
    rounds.done()
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row; component is the smallest id reachable over links of at most ``radius`` bits."""
    spark = docs.sparkSession
    with shuffles_removed(spark):
        rounds = Rounds(spark, "near")
        marked = rounds.keep(fingerprints(docs, words, seed, id_col, text_col), "marked")
        nodes = rounds.keep(marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("node"), F.count("*").alias("_rows")), "nodes")
        paths = [new_path(spark, "links"), new_path(spark, "components")]
        joined = components(links(nodes.where("node is not null").select("node", "fp"), radius, paths[0]), path=paths[1])
        named = rounds.keep(nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "_rows"), "named")
        out = written(with_hot(marked, named, "fp", marked.count()).select(id_col, "fp", "component"), "near")
        rounds.done()
        for path in paths:
            discard(spark, path)
    return out


#: Documents whose shingles are counted for the order of shingles, the least count that matters there, and shingles with a count at most. All three
#: are for speed: with any order the candidates are complete.
COUNTED_DOCS, OFTEN, COUNTED = 5_000, 3, 200_000
#: Counted documents with a shingle from which its rows are dealt in parts, and documents a part at most.
HOT_COUNT, PART_DOCS = 10, 65_536
#: Sets under one key in a block, and pairs that are decided at a time for two groups of joined sets once one of theirs was not similar.
GROUP, TRIES = 1024, 8
#: Bits of a set's mark.
MARK = 1024
_TINY = 1e-9  # products of a similarity and a count may be off by less


def frequent(docs: DataFrame, n_docs: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts among some documents."""
    every = max(1, -(-n_docs // COUNTED_DOCS))
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)

    def run(texts: list) -> list:
        return [[np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts]]

    each = map_texts(some, id_col, text_col, run, "keys array<long>").select(F.explode("keys").alias("key"))
    counts = each.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(COUNTED).toArrow()
    keys, n = counts.column("key").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(hashes: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the order of frequency, then hash: sets of at least that similarity share one of theirs. hashes are distinct."""
    n = len(hashes)
    if not n:
        return hashes
    count = np.zeros(n, np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
        count = np.where(often[0][at] == hashes, often[1][at], 0)
    return hashes[np.lexsort((hashes, count))[: n - math.ceil(least * n - _TINY) + 1]]


def set_hash(distinct: np.ndarray) -> int:
    """Hash of a set of shingles."""
    return int(np.bitwise_xor.reduce(distinct * np.uint64(0x9E3779B97F4A7C15))) ^ len(distinct) if len(distinct) else 0


def mark(distinct: np.ndarray, bits: int = MARK) -> bytes:
    """Of each of that many bins, whether it has an odd number of shingles: marks differ in no more bits than sets in shingles."""
    odd = np.bincount((distinct % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_mark(distinct: np.ndarray) -> bytes:
    """The mark of a large set, of a power of two of bits, four a shingle or more; empty where MARK bits are as many."""
    bits = 1 << max(0, 4 * len(distinct) - 1).bit_length()
    return mark(distinct, bits) if bits > MARK else b""


def differing(one: bytes, two: bytes) -> int:
    """Bits in which marks differ, the larger one folded to the size of the other."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def describe(docs: DataFrame, words: int, least: float, shingles: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, same, n, keys, mark, wide): fingerprint, hash and size of the set of shingles, its prefix and marks."""
    often = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(texts: list) -> list:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for t in texts:
            hashes = shingle_hashes(t, words)
            distinct = np.unique(hashes)
            for column, x in zip(out, (majority(hashes), set_hash(distinct), len(distinct), prefix(distinct, least, often.value).view(np.int64), mark(distinct), wide_mark(distinct)), strict=True):
                column.append(x)
        return [np.array(out[0], np.uint64).view(np.int64), np.array(out[1], np.uint64).view(np.int64), *out[2:]]

    return map_texts(docs, id_col, text_col, run, "fp long, same long, n long, keys array<long>, mark binary, wide binary")


def shingle_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(same, shingles): the different sets of shingles of the texts, hashes ascending in 8 bytes each. No text is dealt."""

    def run(texts: list) -> list:
        sets = [np.unique(shingle_hashes(t, words)) for t in texts]
        return [np.array([set_hash(s) for s in sets], np.uint64).view(np.int64), [s.tobytes() for s in sets]]

    return map_texts(docs, id_col, text_col, run, "same long, shingles binary").select("same", "shingles").dropDuplicates(["same"])


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets of at least that similarity, by the number of shingles in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(both >= least * (len(one) + len(two) - both) - _TINY)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (sets.select(F.col("same").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return bounded(pairs.join(one, "a").join(two, "b")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def possible_by_marks(pairs: DataFrame, marks: DataFrame, least: float, rounds: Rounds) -> DataFrame:
    """The pairs (a, b) without those that differ in too many bits to be of that similarity. marks: (same, n, mark, wide).

    First by the marks of MARK bits, which tell small sets apart; what is left, by
    the wide marks of large ones.
    """
    share = (1 - least) / (1 + least)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            ok = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= n * share + _TINY
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            bits = [differing(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(bits, np.int64) <= n * share + _TINY, pa.bool_()))

    def meet(some: DataFrame, what: Column, check: Callable) -> DataFrame:
        one, two = (marks.select(F.col("same").alias(k), F.col("n").alias(n), what.alias(v)) for k, n, v in (("a", "n", "x"), ("b", "m", "y")))
        return bounded(some.join(one, "a").join(two, "b")).select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long")

    left = rounds.keep(meet(pairs, F.col("mark"), narrow), "by-mark")
    return meet(left, F.when(F.octet_length("wide") > 0, F.col("wide")).otherwise(F.col("mark")), wide)


def group_forest(members: dict[str, list], least: float, tries: int) -> Iterator[tuple[int, int]]:
    """(i, j) pairs of sets that may be of that similarity, up to ``tries`` for each two labels that they join.

    Members of one label are joined already. Of two blocks only pairs across them are
    compared; pairs that were rejected before are passed over.
    """
    same, size, block, label = (np.array(members[c], np.int64) for c in ("same", "size", "block", "component"))
    n, at, apart = size >> 32, size & 0xFFFFFFFF, len(set(members["block"])) > 1
    marks = np.frombuffer(b"".join(members["mark"]), np.uint64).reshape(len(same), -1)
    share = (1 - least) / (1 + least)
    tried: Counter = Counter()
    for i in range(len(same) - 1):
        j = np.arange(i + 1, len(same))
        j = j[(label[j] != label[i]) & ((block[j] != block[i]) | (not apart))]
        both = n[i] + n[j]
        j = j[np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= both * (least / (1 + least)) - _TINY]
        j = j[np.bitwise_count(marks[j] ^ marks[i]).sum(axis=1, dtype=np.int64) <= (n[i] + n[j]) * share + _TINY]
        for k in j.tolist():
            if label[k] == label[i] or int(same[k]) in members["rejected"][i]:
                continue
            if differing(members["wide"][i] or members["mark"][i], members["wide"][k] or members["mark"][k]) <= (n[i] + n[k]) * share + _TINY:
                yield i, k
                joined = (min(label[i], label[k]), max(label[i], label[k]))
                tried[joined] += 1
                if tried[joined] == tries:
                    label[label == label[k]] = label[i]


def group_pairs(entries: DataFrame, marks: DataFrame, rejected: DataFrame, least: float, tries: int) -> DataFrame:
    """(key, a, b): the pairs of group_forest of each key. entries: (key, same, size, component).

    Keys of more than ``GROUP`` sets are dealt in blocks, and each two blocks meet in a
    task of their own.
    """
    per_key = entries.groupBy("key").agg(F.count("*").alias("_rows"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    apart = per_key.where("_low <> _high and _rows > 2").select("key", F.ceil(F.col("_rows") / GROUP).cast("int").alias("_blocks"))  # two sets have met as a star
    bad = rejected.select(F.col("a").alias("same"), F.col("b").alias("_other")).unionAll(rejected.select(F.col("b").alias("same"), F.col("a").alias("_other")))
    bad = bad.groupBy("same").agg(F.collect_set("_other").alias("rejected"))  # what the marks let pass and the sets did not
    block = F.pmod(F.xxhash64("same"), F.col("_blocks")).cast("int")
    rows = entries.join(apart, "key").withColumn("block", block).join(marks, "same").join(bad, "same", "left")
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_p", F.least("block", "_with")).withColumn("_q", F.greatest("block", "_with"))
    names = ["key", "_p", "_q", "same", "size", "block", "component", "mark", "wide", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {c: [] for c in names[3:]}

        def flush() -> pa.RecordBatch:
            pairs = list(group_forest(held, least, tries)) if len(held["same"]) > 1 else []
            ends = [(held["same"][i], held["same"][j]) for i, j in pairs]
            out = [[at[0]] * len(ends), [max(x) for x in ends], [min(x) for x in ends]]
            for c in held.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for key, p, q, *rest in zip(*columns, strict=True):
                if (key, p, q) != at:
                    if at is not None and (done := flush()).num_rows:
                        yield done
                    at = key, p, q
                rest[-1] = frozenset(rest[-1] or ())
                for c, x in zip(held.values(), rest, strict=True):
                    c.append(x)
        if at is not None:
            yield flush()

    dealt = bounded(rows.select(*names)).repartition("key", "_p", "_q").sortWithinPartitions("key", "_p", "_q", "same")
    return dealt.mapInArrow(run, "key long, a long, b long")


def similar_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], hot: np.ndarray, salts: int, least: float, path: str | None = None) -> DataFrame:
    """(a, b), written: links whose components are those of all pairs of at least that similarity. nodes: (same, n, keys, mark, wide), equal sets may repeat; sets: (same, shingles) of sets (same).

    Two such sets share a key, since the keys are prefixes in one order, and each
    pair is decided by its shingles. First every set meets the smallest one under
    each of its keys. Then sets under a key that are not joined yet are compared where
    they are, by their marks; a task sends on the pairs that would join its group, and
    these are decided. Keys with a pair that is not similar after all are compared
    again without it, until none is left. ``hot`` keys, which many sets may have, are
    dealt in ``salts`` parts, whose smallest sets then meet.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of equal sets in a batch one, so that a key has few rows for many copies
            _, first = np.unique(batch.column("same").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(first)))
            keys = batch.column("keys")
            lens = keys.value_lengths().to_numpy()
            place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            size, same, key = np.repeat(batch.column("n").to_numpy(), lens), np.repeat(batch.column("same").to_numpy(), lens), keys.flatten().to_numpy()
            salt = np.where(np.isin(key, hot), same % salts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, same, (size << 32) | place, salt)], ["key", "same", "size", "salt"])

    flat = nodes.select("same", "n", "keys").mapInArrow(entries, "key long, same long, size long, salt long")
    order = Window.partitionBy("key", "salt").orderBy("same")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = flat.withColumn("first", F.first(F.struct("same", "size")).over(running)).withColumn("_next", F.lead("same").over(order))
    met = met.where((F.col("first.same") != F.col("same")) | (F.col("_next") != F.col("same")) | ((F.col("salt") >= 0) & F.col("_next").isNull())).drop("_next")
    spark = nodes.sparkSession
    held_path = now_path = new_path(spark, "held")
    held = written(met, "held", held_path)  # the entries of shared keys, with the smallest set under the key
    rounds = Rounds(spark, "similar")
    firsts = held.where("salt >= 0 and first.same = same").select("key", "same", "size").distinct()  # ``salts`` a hot key
    low = firsts.groupBy("key").agg(F.min(F.struct("same", "size")).alias("first"))

    def n(size: Column) -> Column:
        return F.shiftright(size, 32)

    def at(size: Column) -> Column:
        return size.bitwiseAND(F.lit(0xFFFFFFFF))

    def possible(x: Column, y: Column) -> Column:
        """Whether sets that share shingles at these places can have enough in common: before the places and from them on."""
        return F.least(at(x), at(y)) + F.least(n(x) - at(x), n(y) - at(y)) >= F.ceil((n(x) + n(y)) * F.lit(least / (1 + least)) - F.lit(_TINY))

    def alike_of(some: DataFrame, k: int) -> DataFrame:
        return rounds.keep(alike(some, sets(some.select(F.explode(F.array("a", "b")).alias("same")).distinct()), least), f"good-{k}")

    def named(entries: DataFrame, links: DataFrame, path: str) -> DataFrame:
        at = new_path(spark, "components")
        joined = components(links, path=at).withColumnRenamed("node", "same")
        out = written(entries.join(joined, "same", "left").withColumn("component", F.coalesce("component", "same")), "named", path)
        discard(spark, at)
        return out

    marks = nodes.select("same", "n", "mark", "wide").dropDuplicates(["same"])
    stars = held.select("same", "size", "first").unionByName(firsts.join(F.broadcast(low), "key").select("same", "size", "first"))
    stars = stars.where((F.col("same") != F.col("first.same")) & possible(F.col("size"), F.col("first.size")))
    stars = stars.select(F.greatest("same", "first.same").alias("a"), F.least("same", "first.same").alias("b")).distinct()
    stars = rounds.keep(stars, "stars")
    stars = rounds.keep(possible_by_marks(stars, marks, least, rounds), "stars-left")
    linked = alike_of(stars, 0)
    rejected = rounds.keep(stars.join(linked, ["a", "b"], "left_anti"), "bad-0")
    entries = held.select("key", "same", "size").distinct()
    tries, entries, grown, k = 1, entries.withColumn("component", F.col("same")), True, 0
    lasting = ["good-0", "bad-0"]
    while True:
        k += 1
        if grown:
            before, now_path = now_path, new_path(spark, "named")
            entries = named(entries.drop("component"), linked, now_path)
            discard(spark, before)  # what the entries were read from until now
            rounds.done(*lasting)
        found = rounds.keep(group_pairs(entries, marks.drop("n"), rejected, least, tries), f"found-{k}")
        pairs = rounds.keep(found.select("a", "b").distinct(), f"pairs-{k}")
        good = alike_of(pairs, k)
        bad = rounds.keep(pairs.join(good, ["a", "b"], "left_anti"), f"bad-{k}")
        lasting += [f"good-{k}", f"bad-{k}"]
        if grown := bool(good.take(1)):
            linked = linked.unionAll(good)
        if not bad.take(1):
            out = written(linked, "similar", path)
            discard(spark, now_path)
            rounds.done()
            return out
        tries, rejected = TRIES, rejected.unionAll(bad)
        before, now_path = now_path, new_path(spark, "entries")
        entries = written(entries.join(found.join(bad, ["a", "b"]).select("key").distinct(), "key", "left_semi"), "entries", now_path)
        discard(spark, before)


def _groups(docs: DataFrame, words: int, radius: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(node, component), written, of the ids that are grouped with others."""
    n = docs.count()
    often = frequent(docs, n, words, id_col, text_col)
    hot = often[0][often[1] >= HOT_COUNT].view(np.int64)
    spark = docs.sparkSession
    paths = [new_path(spark, x) for x in ("described", "links", "similar")]
    seen = written(describe(docs, words, least, often, id_col, text_col).where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "node"), "described", paths[0])
    by_set, by_fp = (seen.groupBy(k).agg(F.min("node").alias("first"), F.count("*").alias("_rows")) for k in ("same", "fp"))
    joined = [with_hot(seen.select("node", k), first, k, n).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")) for k, first in (("same", by_set), ("fp", by_fp))]
    near = links(by_fp.select(F.col("first").alias("node"), "fp"), radius, paths[1])

    def sets(some: DataFrame) -> DataFrame:
        ids = by_set.join(some, "same").select(F.col("first").alias(id_col)).distinct()
        return shingle_sets(docs.join(ids, id_col, "left_semi"), words, id_col, text_col)

    pairs = similar_links(seen.select("same", "n", "keys", "mark", "wide"), sets, hot, max(16, -(-n // PART_DOCS)), least, paths[2])
    one, two = (by_set.select(F.col("same").alias(k), F.col("first").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    similar = pairs.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    out = components(joined[0].unionAll(joined[1]).unionAll(near).unionAll(similar))
    for path in paths:
        discard(spark, path)
    return out


def keep_first(docs: DataFrame, words: int = 5, radius: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: that with the smallest id, or of rows that repeat it one. Rows without an id stay.

    Groups are joined by fingerprints within the radius, and by a similarity of at
    least ``least`` between the sets of shingles, which at 0.8 leaves ten bits between
    fingerprints or more. Texts of sets that share a key are read twice.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        found = _groups(docs, words, radius, least, id_col, text_col)
    drop = found.where("node <> component").select(F.col("node").alias(id_col)).distinct()
    kept = docs.join(drop, id_col, "left_anti")
    alone = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))  # rows without an id need no common task
    once = kept.withColumn("_nth", F.row_number().over(Window.partitionBy(id_col, alone).orderBy(F.xxhash64(text_col))))
    return once.where((F.col("_nth") == 1) | F.col(id_col).isNull()).drop("_nth")
