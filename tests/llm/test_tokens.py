"""Encoding, counting and storing of tokens against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accountlens.llm import bpe, queries, token_counts, token_store, transducer
from accountlens.llm.scan import TransitionScan

PARTS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "É", "ß", "the", "1", "²", "½", "٣", "!", "==", "日本", "👍🏽", "é", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "S", "'S", "Σ", "0" * 40, "a" * 300]


def texts(n: int = 1500) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "\n", " " * 1000, "ab" * 2000, "x" * 5000]


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=600))
def test_scan_is_the_sequential_run(symbols):
    delta = np.array([[1, 2, 0, 3], [0, 0, 3, 1], [2, 2, 2, 2], [0, 1, 2, 3]])
    state, want = 0, []
    for s in symbols:
        want.append(state)
        state = delta[s][state]
    assert TransitionScan(delta).states_before(np.array(symbols, np.uint8)).tolist() == want


def test_encoding_is_the_librarys(library):
    codec = bpe.ranks_codec(P.path("byte_bpe_50k.tiktoken"))
    some = texts()
    for t, ids in zip(some, codec.encode([x.encode() for x in some]), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_long_text_in_blocks_and_cache_that_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    codec = bpe.ByteLevelBPE.from_ranks(P.path("byte_bpe_50k.tiktoken"))
    long = " ".join(f"word{i} it's, {i * 7}" for i in range(5000))
    assert next(codec.encode([long.encode()])).tolist() == library.encode_ordinary(long)
    assert [x.tolist() for x in codec.encode([None, b"", b"a"])] == [[], [], library.encode_ordinary("a")]


def test_json_vocabulary_with_special_strings():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = texts(500)
    want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.json_codec(P.path("byte_bpe_50k.json")).encode([x.encode() for x in some])] == want


def test_counts_are_the_librarys():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    some = texts(800)
    want = [len(e.ids) for e in t.encode_batch(some, add_special_tokens=False)]
    got = token_counts.TokenCounter(P.path("word_bpe_49k.json")).count([x.encode() for x in some])
    assert got.tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    e = token_store.EliasFano.load(token_store.EliasFano.of(np.array(values, np.int64)).dump())
    assert e.values().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(token_store.EliasFano.of(ends).dump()) < 10_000 * 2


def table(spark):
    rows = [(1, "one two", "x"), (None, "no id", "x"), (3, None, "y"), (2, "", "y"), (5, "same <|endoftext|> text", "z"), (4, "same <|endoftext|> text", "z"), (5, "same <|endoftext|> text", "z"), (9, "long " * 3000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_round_trip_of_odd_rows(spark, library):
    got = sorted(map(tuple, bpe.round_trip(table(spark), P.path("byte_bpe_50k.tiktoken")).collect()), key=repr)
    want = []
    for r in table(spark).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    empty = table(spark).where("false")
    assert bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0
    ids = bpe.encode_column(table(spark), P.path("byte_bpe_50k.tiktoken"))
    back = bpe.decode_column(ids, P.path("byte_bpe_50k.tiktoken"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in table(spark).collect())


def test_store_of_odd_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    token_store.write_tokens(table(spark), path, P.path("byte_bpe_50k.json"))
    t, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for r in sorted(table(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_store.read_tokens(spark, path)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want
    shard = spark.read.parquet(path).where("n_docs > 0").first().asDict()
    assert len(token_store.shard_document(shard, 0)) >= 1
    token_store.write_tokens(table(spark).where("false"), path + "0", P.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, path + "0").count() == 0


def test_count_of_odd_rows(spark):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark), P.path("word_bpe_49k.json")).collect()}
    assert got[3, 0] == (0, False) and got[9, 15000] == (3000, True) and got[1, 7] == (2, False)


def test_queries_over_the_whole_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        assert got[k].ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in queries.op7_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(docs[r.doc_id].encode())
    t, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for r in queries.op5_token_store(spark, sf_dir).orderBy("doc_id").collect():
        ids = [*t.encode(docs[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_schema_of_keys_is_kept(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("doc_id"), F.lit("t").alias("text"))
    assert dict(bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken")).dtypes)["doc_id"] == "string"


def every_kind(n: int) -> list[str]:
    """Random strings over all assigned planes, with what patterns treat apart."""
    rng = random.Random(8)
    points = [c for c in range(0x20, 0x34000) if not 0xD800 <= c < 0xE000]
    mixed = ["".join(rng.choice(PARTS) if rng.random() < 0.5 else chr(rng.choice(points)) for _ in range(rng.randint(1, 25))) for _ in range(n)]
    return mixed + ["".join(rng.choice("abcdeabnt ") for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["a" * k for k in range(1, 130)]


def test_all_three_follow_the_libraries_over_all_code_points(library):
    some = every_kind(3000)
    data = [x.encode() for x in some]
    codec = bpe.ranks_codec(P.path("byte_bpe_50k.tiktoken"), bpe.ranks_classes())
    assert [x.tolist() for x in codec.encode(data)] == [library.encode_ordinary(t) for t in some]
    path = P.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    assert [x.tolist() for x in bpe.json_codec(path, bpe.json_classes(path)).encode(data)] == [e.ids for e in want]
    path = P.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    assert token_counts.TokenCounter(path, bpe.json_classes(path)).count(data).tolist() == [len(e.ids) for e in want]


def test_counts_when_the_machine_starts_anew(monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 40)
    path = P.path("word_bpe_49k.json")
    some = ["".join(random.Random(i).choice("abcdefgh1 ") for _ in range(400)) for i in range(30)] + ["q" * 500 + "antidis" * 90]
    want = Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)
    counter = token_counts.TokenCounter(path)
    assert [int(counter.count([t.encode()])[0]) for t in some] == [len(e.ids) for e in want]


@pytest.mark.parametrize(("part", "stretch", "states"), [(1 << 18, 128, 200_000), (1000, 7, 200_000), (500, 50, 300)])
def test_long_words_are_read_in_stretches(monkeypatch, part, stretch, states):
    monkeypatch.setattr(transducer, "PART", part)
    monkeypatch.setattr(transducer, "STRETCH", stretch)
    monkeypatch.setattr(transducer, "STATES", states)
    rng = random.Random(8)
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)), "a" * 2500, "the" * 900, "ab" * 700 + "q", "".join(rng.choices("etaoin", k=97)), "日本語" * 300]
    counter = token_counts.TokenCounter(P.path("word_bpe_49k.json"), bpe.json_classes(P.path("word_bpe_49k.json")))
    want = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert counter.count([t.encode() for t in some]).tolist() == [len(want.encode(t, add_special_tokens=False).ids) for t in some]
