"""Search, mixing, near-duplicates and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from accountlens.llm import mixing, queries, simhash, topk


# Top-k
def brute_top(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 10)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 640)] + [(700, None), (750, [None] * 64), (800, [float("nan")] * 64), (850, [float("inf")] * 64), (900, [1.0, 2.0]), (901, [3.0, 1.0]), (-50, rows[1][1]), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows, 5, 50)
    assert topk.top_k(df.where("false")).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_maxscore_of_a_shard(seed):
    rng = np.random.default_rng(seed)
    scale = rng.choice([1, 5, 200], 48)
    v, q = (rng.normal(size=(n, 48)) * scale for n in (300, 9))
    v, q = np.floor(v).astype(np.int64), np.floor(q).astype(np.int64)
    ids, own = rng.permutation(300), np.arange(9)
    r, c, s = topk.best_of_shard(q, own, v, ids, 5)
    got = sorted(zip(r.tolist(), (-s).tolist(), ids[c].tolist(), strict=True))
    full = q @ v.T
    want = sorted((i, *x) for i in range(9) for x in sorted((-int(full[i, j]), int(ids[j])) for j in range(300) if ids[j] != own[i])[:5])
    assert got == want


def test_maxscore_passes_over_postings_that_cannot_compete():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * 300
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(8000, 64)) * 20).astype(np.int64)
    ids = rng.permutation(8000)
    shard = topk.Shard(v, ids, int(np.abs(v).max()))
    for i in range(0, 8000, 397):
        places, scores = shard.search(v[i], int(ids[i]), 5)
        want = sorted((-int(v[i] @ v[j]), int(ids[j])) for j in range(8000) if j != i)[:5]
        assert sorted(zip((-scores).astype(int).tolist(), ids[places].tolist(), strict=True)) == want
    assert shard.read < 0.1 * 21 * v.size  # of all postings


def test_top_k_of_numbers_beyond_doubles_and_repeated_queries(spark):
    rows = [(i, [float(2**30 + i), -(2.0**29) * i]) for i in range(60)] + [(50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    queries_of = {0: whole[0][1], 50: min(v for i, v in whole if i == 50)}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = [(q, n + 1, i, -s) for q, a in queries_of.items() for n, (s, i) in enumerate(sorted((-clip(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in whole if i != q)[:5])]
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert [(q, r, s) for q, r, _, s in got] == [(q, r, s) for q, r, _, s in sorted(want)]


# Mixing
def test_schedule_stays_within_one_block(spark):
    w = spark.createDataFrame([("a", 5.0), ("b", 3.0), (None, 1.0), ("d", 0.7), ("e", 0.3)], "source string, weight double")
    parts = {r["rank"]: r for r in mixing.periods(w, 100).collect()}
    slots = sorted((r.slot, r["rank"], r.nth) for r in mixing.schedule(mixing.periods(w, 100)).collect())
    total = parts[1].total
    assert [s for s, _, _ in slots] == list(range(total)) and sum(p.p for p in parts.values()) == total
    done = dict.fromkeys(parts, 0)
    for slot, rank, nth in slots:
        done[rank] += 1
        assert nth == done[rank]
        for k, p in parts.items():
            assert abs(done[k] - p.p / total * (slot + 1)) < 1


def test_mixture_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    rows = [(i, "a" if i % 3 else "b", "t") for i in range(500)] + [(None, None, None), (None, None, "x"), (7, "a", "t"), (600, "none", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, block_text string").withColumn("_source", F.lit(1))
    w = mixing.tempered_weights(df.where("source is null or source <> 'none'"))
    got = mixing.mix(df, w, block_docs=4, period=50).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.block, r.place))
        assert [r.block * 4 + r.place for r in mine] == list(range(len(mine)))
        assert all(r.release <= r.slot < r.deadline for r in mine)
    assert all(r.slot is None and not r.in_mix for r in got if r.source == "none")
    blocks = {(r.source, r.block): r.slot for r in got if r.slot is not None}
    assert len(set(blocks.values())) == len(blocks)
    assert mixing.mix(df.where("false"), w).count() == 0


# Near-duplicates
def slow_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + words] for i in range(len(w) - words + 1)] if len(w) >= words else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    n, parent = len(fps), list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_one_at_a_time():
    for t in ["", None, "One", "A b", "the CAT sat\x0bon the mat É", "x y z " * 700, "\t\n "]:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = list({rng.getrandbits(64) for _ in range(200)})
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:80]]
    values = list(dict.fromkeys(values))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_components_of_chains_copies_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0] * 5
    chain = rng.getrandbits(64)
    for i in range(40):  # each two bits from the one before
        fps.append(chain)
        chain ^= (1 << (i % 64)) | (1 << ((i * 7 + 1) % 64))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    one = nodes.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp")
    found = {r.node: r.component for r in simhash.components(simhash.links(one)).collect()}
    want = brute_components(fps)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    assert all(found.get(i, i) == want[i] for i in first.values())


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " end"), (1, None), (2, ""), (4, " \n"), (None, base), (7, "A b"), (8, "a B"), (5, base)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = brute_components(fps)
    ids = {c: min(d for (d, _), w in zip(rows, want, strict=True) if w == c and d is not None) for c in want}
    assert sorted((r.doc_id or 0, r.component) for r in got) == sorted((d or 0, ids[w]) for (d, _), w in zip(rows, want, strict=True))
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = sorted((r.doc_id or 0) for r in simhash.keep_first(df).collect())
    assert kept == [0, 1, 3, 7] and simhash.keep_first(df).columns == df.columns


def test_simhash_query_is_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {docs[i][0]: (f"{fps[i]:016x}", docs[c][0]) for i, c in enumerate(brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf_dir).collect()} == want


def jaccard(a: str, b: str, words: int = 5) -> float:
    x, y = (set(simhash.shingle_hashes(t.encode(), words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_finds_what_is_eight_tenths_alike(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([60, 150, 400, 1500]))
        rows.append((2 * i, " ".join(words)))
        for _ in range(max(1, len(words) // 55) if i % 2 else len(words) // 8):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((2 * i + 1, " ".join(words)))
        pairs.append(jaccard(rows[-1][1], rows[-2][1]))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in enumerate(pairs):
        assert 2 * i in kept
        if s >= 0.84 or s < 0.74:
            assert (2 * i + 1 in kept) == (s < 0.8), s
    assert sum(s >= 0.84 for s in pairs) > 5


# Pipeline
def test_pipeline_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    ids = set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        assert 0 < len(ids) < n or name == "language_id"
    last = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in last} == ids and all(r.n_tokens > 0 for r in last)
    empty = queries.table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_mixing_stage_keeps_every_document(spark, sf_dir):
    rows = [(i, f"text {i}", "en", None if i < 3 else "rare" if i < 10 else "large", 6) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.mix_to_weights(spark, docs, sf_dir).collect()]
    assert sorted(got) == list(range(300))
    order = mixing.mix(docs, mixing.tempered_weights(docs, 0.5)).orderBy("slot", "place").collect()
    assert got == [r.doc_id for r in order]


def test_stage_decides_short_texts_and_close_pairs_like_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(90):
        size = rng.choice([5, 8, 10, 11, 13, 18, 34, 64, 500])
        words = [rng.choice(["a", "b", "c"]) if rng.random() < 0.1 else f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows.append(" ".join(words))
        rows.append(" ".join(words[: size - rng.randrange(1, 3)]))  # the longest change at an end: 6 of 7 shingles and so on
        cut = round((size - 4) * rng.uniform(0.17, 0.23))
        rows.append(" ".join(words[: size - cut]))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    label = {i: i for i in sets}
    close = 0
    for i in sorted(sets):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += 0.8 <= s < 0.84
            if s >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 3:
                low, high = sorted((label[i], label[j]))
                label = {k: low if c == high else c for k, c in label.items()}
    assert close > 20
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(label.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_crowded_keys_are_those_of_brute_force(spark, monkeypatch, seed):
    """Small blocks, salts and tries, so that all of them come into play."""
    for name, value in (("GROUP", 3), ("HOT_COUNT", 3), ("TRIES", 2), ("SHARD", 8)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.choice((30, 60)))) for _ in range(12)]
    shared = " ".join(f"s{i}" for i in range(12))
    texts = []
    for _ in range(140):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words) + (" " + shared if rng.random() < 0.5 else ""))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted({root(i) for i in range(len(texts))})
