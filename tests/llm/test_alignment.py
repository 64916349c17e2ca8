"""Alignment of two tokenizers against the libraries and a plain count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accountlens.llm import alignment, queries
from accountlens.llm.bpe import json_classes

ONE, TWO = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["'s", " ", "  ", "\n", "\t", "a", "É", "ß", "the", "1", "²", "½", "!", "==", "日本", "👍🏽", "é", "\x1c", "\x85", "<s>", "<0x41>", "</s>", "<|endoftext|>", "▁", "S", "0" * 40, "abc" * 20, "x.y", "foo,bar", "ﬁ", "　", "\x00"]


def texts(n: int, seed: int = 3) -> list:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", None]


@pytest.fixture(scope="module")
def plain():
    worker = alignment.aligner(ONE, TWO, json_classes(ONE))
    one, two = Tokenizer.from_file(ONE), sentencepiece.SentencePieceProcessor(model_file=TWO)
    one.encode_special_tokens = True

    def groups(text):
        """[(ids, ids)] by the libraries on the whole text; none where their tokens do not spell it."""
        if not text:
            return []
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        x, y = [worker.one.tokens[i] for i in a], [worker.two.spelled[i] for i in b]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            return []
        x, y = (np.cumsum([len(t) for t in z]).tolist() for z in (x, y))
        out, i, k = [], 0, 0
        for end in sorted(set(x) & set(y)):
            n, m = x.index(end, i) + 1, y.index(end, k) + 1
            out.append((a[i:n], b[k:m]))
            i, k = n, m
        return out

    return groups


def shown(groups) -> str:
    return ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)


def links(groups) -> Counter:
    return Counter((a, b) for p, q in groups for a in p for b in q)


def test_groups_are_those_of_the_libraries(plain):
    worker = alignment.aligner(ONE, TWO, json_classes(ONE))
    some = texts(1500)
    for text, found in zip(some, alignment.align_texts([None if t is None else t.encode() for t in some], worker), strict=True):
        want = plain(text)
        assert found.written[:-1].decode() == shown(want)
        assert found.n_links == sum(links(want).values())
        assert dict(zip(found.codes.tolist(), found.times.tolist(), strict=True)) == {a * alignment.RADIX + b: n for (a, b), n in links(want).items()}


@pytest.mark.parametrize("size", [3, 17, 64])
def test_fragments_compose_in_any_order(size, plain):
    worker = alignment.aligner(ONE, TWO, json_classes(ONE))
    for text in texts(300, size):
        if not text:
            continue
        data = (" " + text).encode()
        cuts = zip(alignment.ranges(data, alignment._CUT_ONE, size), alignment.ranges(data, alignment._CUT_TWO, size), strict=True)
        some = [alignment.range_fragment(data[a:b], a, data[c:d], c, worker) for (a, b), (c, d) in cuts]
        by_tree = alignment.whole(alignment.tree(some, worker.shown), worker.shown)
        in_turn = alignment.whole(reduce(lambda x, y: alignment.compose(x, y, worker.shown), some), worker.shown)
        assert by_tree.written == in_turn.written
        assert by_tree.written[:-1].decode() == shown(plain(text))
        assert (by_tree.codes == in_turn.codes).all()
        assert (by_tree.times == in_turn.times).all()


def test_large_groups_are_counted_first(monkeypatch, plain):
    worker = alignment.aligner(ONE, TWO, json_classes(ONE))
    text = "0" * 4000 + " the end"
    want = alignment.align_texts([text.encode()], worker)[0]
    monkeypatch.setattr(alignment, "LARGE", 1)
    got = alignment.align_texts([text.encode()], worker)[0]
    assert got.written == want.written
    assert got.codes.tolist() == want.codes.tolist()
    assert got.times.tolist() == want.times.tolist()


def expected(rows, plain) -> list:
    found = [(i, plain(t)) for i, t in rows]
    count, best = Counter(p for _, g in found for p in links(g)), defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, g in found:
        x = links(g)
        out.append((i, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(x.values()), sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(shown(g).encode()).hexdigest() if g else ""))
    return out


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_counts_over_all_rows_with_long_texts_in_ranges(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 100)
    monkeypatch.setattr(alignment, "FAN", 6)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 300)
    rows = [*enumerate(texts(60)), (7, "again"), (None, "no id"), (900, "word, " * 400), (901, "日本語" * 200), (902, "a,b.c;d" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("block", F.lit("x"))
    out = alignment.alignment(df, ONE, TWO)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(out.collect()) == ordered(expected(rows, plain))


def test_no_rows(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), ONE, TWO).collect() == []


def test_query(spark, sf_dir, plain):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert ordered(queries.op11_alignment(spark, sf_dir).collect()) == ordered(expected(rows, plain))
