"""Quality, language, media and chat operators."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accountlens.llm import chat, langid, media, quality, queries

ODD = [(1, "the cat and the dog of the house"), (2, None), (3, ""), (4, "123 !!"), (None, "der Hund und die Katze"), (1, "the cat and the dog of the house"), (7, "der Hund und die Katze " * 2000)]


def odd(spark):
    return spark.createDataFrame([(*r, "en" if r[1] and "the" in r[1] else "de", 1) for r in ODD], "doc_id long, text string, lang string, score int")


# Quality
def noisy(n: int):
    rng = np.random.default_rng(1)
    words = ["house", "tree", "river", "and", "the", "of", "mountain", "light"]
    out = []
    for i in range(n):
        good = i % 4 != 0
        w = rng.choice(words, 60)
        out.append((" ".join(w if good else [x + rng.choice(["$$$", "###"]) for x in w]).encode(), int(good)))
    return out


def test_network_learns_and_reads_whole_texts():
    data = noisy(400)
    net = quality.fit([t for t, _ in data[:300]], [y for _, y in data[:300]])
    p = net.probability([t for t, _ in data[300:]])
    y = np.array([y for _, y in data[300:]])
    assert ((p >= quality.THRESHOLD) == y).mean() > 0.97
    clean, junk = data[301][0], data[300][0]
    far = clean * 2000  # longer than a block: junk at its very end is seen
    assert len(far) > quality.BLOCK
    before, after = net.pooled([far, far + b" " + junk])
    assert (after >= before - 1e-4).all() and (after > before + 1e-3).any()


def test_pooling_is_the_maximum_over_all_chunks(monkeypatch):
    net = quality.ByteCNN.fresh(3)
    texts = [b"", b"abc", b"x" * 8, b"hello world, this is longer than a chunk", bytes(range(256)) * 3]
    got = net.pooled(texts)
    for t, g in zip(texts, got, strict=True):
        halves, _ = quality.layout([t])
        chunks = [net.embed[np.concatenate([halves[i], halves[i + 1]])].ravel() @ net.filters for i in range(len(halves) - 1)]
        assert np.allclose(g, np.maximum(np.max(chunks, axis=0) + net.bias, 0), atol=1e-4)


def test_quality_query_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality_cnn(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9


def test_quality_of_odd_rows(spark):
    net = quality.fit([b"a"], [1])  # one class: nothing to learn
    assert {r.score > 0.99 for r in quality.score(odd(spark), net).collect()} == {True}
    assert quality.score(odd(spark).where("false"), net).count() == 0
    assert quality.train(odd(spark), spark.createDataFrame([], "doc_id long, quality int")) is not None
    assert quality.keep(odd(spark), net).columns == odd(spark).columns


# Language
def brute_phrases(sample: list[int], text: list[int], stretch: int) -> int:
    """Longest matches by searching the sample itself."""
    s, n = ",".join(map(str, sample)) + ",", 0
    for a in range(0, len(text), stretch):
        part, i = text[a : a + stretch], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and "," + ",".join(map(str, part[i : j + 1])) + "," in "," + s:
                j += 1
            n += 1
            i = j
    return n


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 50)
    p = langid.CrossParser({"de": "der hund und die katze " * 3 + "das haus am see", "en": "the cat and the dog " * 3 + "a house by the sea"})
    texts = ["the dog by the sea", "Das Haus!", "zzz 12 the", "", "the cat " * 30]
    got, n = p.phrases(texts)
    for k, language in enumerate(p.languages):
        sample = p.compact([{"de": "der hund und die katze " * 3 + "das haus am see", "en": "the cat and the dog " * 3 + "a house by the sea"}[language]])[0].tolist()
        for i, t in enumerate(texts):
            assert got[k, i] == brute_phrases(sample, p.compact([t])[0].tolist(), 10**6)


def test_phrases_go_on_over_stretches_and_rare_letters(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 7)
    rng = np.random.default_rng(5)
    make = lambda n: "".join(rng.choice(list("abc жщ日本ß"), n))
    samples = {"x": make(300), "y": make(200)}
    p = langid.CrossParser(samples)
    texts = [make(int(n)) for n in rng.integers(0, 120, 25)]
    got, n = p.phrases(texts)
    for k, language in enumerate(p.languages):
        sample = p.compact([samples[language]])[0].tolist()
        assert [brute_phrases(sample, p.compact([t])[0].tolist(), 10**6) for t in texts] == got[k].tolist()


def test_letters_of_any_script_are_told_apart():
    everything = "".join(chr(i) for i in range(0x3041, 0x3097)) + "".join(chr(i) for i in range(0x4E00, 0x4F00))
    p = langid.CrossParser({"a": "abc " * 20, "b": everything})
    codes = [tuple(p.compact([c])[0].tolist()) for c in everything]
    assert len(set(codes)) == len(everything) and p.predict([everything[90:140].encode()])[0] == ["b"]


def test_language_of_odd_rows(spark):
    samples = langid.learn(odd(spark))
    rows = langid.identify(odd(spark), (("de", "der hund und die katze"), ("en", "the cat and the dog of the house"))).collect()
    got = {(r.doc_id, r.lang_pred) for r in rows}
    assert {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (7, "de")} == got and len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {k for k, _ in samples} <= {"de", "en"}
    assert {r.lang_pred for r in langid.identify(odd(spark), ()).collect()} == {"und"}
    assert langid.identify(odd(spark).where("false"), samples).count() == 0


def test_language_query_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_cross_parsing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97


def test_language_stage_keeps_the_learned_languages_and_no_other(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю, пожалуйста", "See https://example.org/abc page: Съешь же ещё этих мягких французских булок, выпей чаю", "日本語のテキストはここにあります", "Ταχίστη αλώπηξ βαφής ψημένη γη", "12 34", "", None]
    both = docs.unionByName(spark.createDataFrame([(-i, t, None) for i, t in enumerate(foreign, 1)], "doc_id long, text string, lang string"))
    samples = langid.learn(both)
    limits = langid.learn_limits(both, samples)
    kept = {r.doc_id for r in langid.keep(both, samples, limits).collect()}
    lettered = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert kept == lettered


# Media
def slow_pairs(payload: bytes) -> list[tuple[int, int]]:
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    n = len(x) // media.HOP - 1
    peaks = []
    for t in range(n):
        s = x[t * media.HOP : t * media.HOP + media.FRAME] @ media._table().astype(float)
        p = s[: media.BINS] ** 2 + s[media.BINS :] ** 2
        peaks.append([(a + int(p[a:b].argmax()), p[a:b].max() * (b - a) > 3 * p[a:b].sum()) for a, b in media.BANDS])
    out = []
    for t in range(n):
        for d, i, j in itertools.product(range(1, media.REACH + 1), range(len(media.BANDS)), range(len(media.BANDS))):
            if t + d < n and peaks[t][i][1] and peaks[t + d][j][1]:
                out.append((t, peaks[t][i][0] << 11 | peaks[t + d][j][0] << 2 | d))
    return out


def test_fingerprints_against_one_frame_at_a_time():
    rng = np.random.default_rng(0)
    tone = (128 + 100 * np.sin(np.arange(576 * 6) * 0.3)).astype(np.uint8).tobytes()
    payloads = [media.padded(None), media.padded(b"hello world " * 300), tone, media.padded(rng.integers(0, 255, 5000, dtype=np.uint8).tobytes())]
    for p, (t, c) in zip(payloads, media.fingerprints(payloads), strict=True):
        assert list(zip(t.tolist(), c.tolist(), strict=True)) == slow_pairs(p)
    assert len(next(media.fingerprints([tone]))[0]) > 0


def test_a_tone_at_every_frequency_is_a_peak():
    t = np.arange(media.FRAME * 2)
    for f in range(1, media.BINS):
        bins, strong = media.peaks((128 + 90 * np.cos(2 * np.pi * t * f / media.FRAME)).astype(np.uint8))
        band = next(k for k, (low, high) in enumerate(media.BANDS) if low <= f - 1 < high)
        assert strong[:, band].all() and (abs(bins[:, band] - (f - 1)) <= 1).all(), f


def test_media_round_trip_and_digests(spark):
    rows = {(r.doc_id, r.n_bytes): r for r in media.digests(odd(spark)).collect()}
    assert len(rows) == len(ODD) - 1  # a repeated row
    for (doc_id, n), r in rows.items():
        text = next((t or "").encode() for i, t in ODD if i == doc_id)
        payload = media.padded(text)
        assert n == len(text) and r.payload_bytes == len(payload) and len(payload) % 576 == 0 and len(payload) > 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(payload) + 44
    full = media.media_columns(odd(spark)).join(media.digests(odd(spark)).select("doc_id", "n_bytes").distinct(), "doc_id")
    assert {r.text for r in media.decoded(full).collect()} == {t or "" for i, t in ODD if i is not None}
    assert media.digests(odd(spark).where("false")).count() == 0


# Chat
def brute(model: chat.RoleModel, rows) -> list[int]:
    steps = model.steps(rows, True)
    best = max(itertools.product(range(3), repeat=len(steps)), key=lambda p: (sum(s[a][b] for s, a, b in zip(steps, (0, *p), p)), [-x for x in p]))  # noqa: B905
    return list(best)


def test_viterbi_is_the_best_path():
    model = chat.RoleModel({2: 5, 1: 2}, {(2, 0): 9, (0, 2): 8, (1, 2): 2}, {(0, 6): 5, (2, 1): 4, (1, 0): 1})
    rows = [chat.observe(None, "Hi?\nmore"), chat.observe("assistant", "Yes " * 30), chat.observe("??", "User: then\nBot: fine"), chat.observe(None, "ok?")]
    steps = model.steps(rows, True)
    score = lambda p: sum(s[a][b] for s, a, b in zip(steps, (0, *p), p))  # noqa: B905, E731
    assert score(chat.viterbi(steps, 0)) == pytest.approx(score(brute(model, rows)))
    cut = [chat.compose(steps[:2]), chat.compose(steps[2:])]
    mid, end = chat.viterbi(cut, 0)
    assert score(chat.viterbi(steps[:2], 0, mid) + chat.viterbi(steps[2:], mid, end)) == pytest.approx(score(brute(model, rows)))


def test_roles_of_marked_lines_and_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello.\nWhat now"), (1, 2, None, "User: go on\nAssistant: fine"), (2, 0, "system", None), (2, 0, "system", None), (None, 1, "user", "x"), (None, 1, "user", "y"), (3, None, "user", "early"), (3, 1, "assistant", "late")]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = chat.format_chats(df).collect()
    by = {(r.conv_id, r.turn, r.part): r for r in got if r.conv_id is not None}
    assert by[1, 2, 0].role == "user" and by[1, 2, 0].rendered == "<|user|>\ngo on\n<|end|>\n" and by[1, 2, 1].role == "assistant"
    assert by[2, 0, 0].copies == 2 and by[2, 0, 0].rendered == "<|system|>\n\n<|end|>\n"
    assert by[1, 1, 0].n_lines == 2 and by[3, None, 0].role == "user"
    assert all(by[9, t, 0].role == ("user" if t % 2 == 0 else "assistant") for t in range(300))  # five blocks
    assert sum(r.conv_id is None for r in got) == 2
    assert chat.format_chats(df.where("false")).count() == 0


def test_hidden_roles_are_recovered(spark):
    d = "/root/testdata/sf0.01"
    c = spark.read.parquet(f"{d}/conversations.parquet")
    hidden = c.withColumn("role", F.when(F.col("turn") % 3 != 1, F.col("role")))
    got = chat.format_chats(hidden).where("part = 0").select("conv_id", "turn", F.col("role").alias("found")).join(c, ["conv_id", "turn"]).where("turn % 3 = 1").collect()
    assert np.mean([r.found == r.role for r in got]) > 0.9


def test_chat_query_recovers_hidden_speakers(spark):
    d = "/root/testdata/sf0.01"
    c = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{d}/conversations.parquet").collect()}
    got = queries.op10_chat_hmm(spark, d).collect()
    assert {(r.conv_id, r.turn) for r in got} == set(c)
    kept = [r for r in got if not r.held_out]
    assert all(r.role == c[r.conv_id, r.turn].role for r in kept)
    assert all(r.rendered_sha256 == hashlib.sha256(chat.turn_text(r.role, c[r.conv_id, r.turn].text.split("\n")).encode()).hexdigest() for r in kept)
    hidden = [r for r in got if r.held_out and r.part == 0]
    right = np.mean([r.role == c[r.conv_id, r.turn].role for r in hidden])
    majority = np.mean([c[r.conv_id, r.turn].role == "user" for r in hidden])
    in_turn = np.mean([c[r.conv_id, r.turn].role == ("assistant" if r.turn % 2 else "user") for r in hidden])
    print(f"hidden {len(hidden)}: found {right:.3f}, majority {majority:.3f}, in turn {in_turn:.3f}")
    assert len(hidden) > 50 and right > 0.93 and right > in_turn > majority - 0.1


def test_markers_are_learned(spark):
    rows = [(i, t, "user" if t % 2 else "assistant", f"{'Bot' if t % 2 else 'User'}: word {t}") for i in range(60) for t in range(4)]  # whose prefixes name the other side
    rows += [(99, 0, "assistant", "User: word 0"), (99, 1, None, "Bot: word")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).where("conv_id = 99 and turn = 1").first().role == "user"


def test_long_texts_are_read_in_windows(monkeypatch):
    samples = {"aa": "der und die das " * 40, "bb": "the and of to " * 40}
    text = "der the und! 12 of  éü die das to and " * 60 + "... " * 50 + "the end"
    whole = langid.CrossParser(samples).phrases([text])
    for block in (7, 100, 513):
        monkeypatch.setattr(langid, "BLOCK", block)
        counts, n = langid.CrossParser(samples).phrases([text])
        assert counts.tolist() == whole[0].tolist()
        assert n.tolist() == whole[1].tolist()
