"""Alignment of two tokenizers' tokens, and how often their tokens stand for each other.

Tokens are byte ranges; offsets where tokens of both tokenizers end cut a text into
groups. Fragments form a monoid: a stretch of tokens of both sides is an open prefix
up to the first common end, closed groups, and an open suffix after the last one;
two neighbouring fragments compose, where common ends may show up between the open
parts. Texts of over CHUNK bytes are cut into byte ranges that Spark deals to tasks,
each side at places where that tokenizer has a token boundary for certain, and their
fragments are composed by tree reduction, FAN at a time.

Id pairs are counted by blocks of documents: a block states each of its pairs once,
gets back the corpus-wide counts of these, and adds them up for its documents.

Defined cases: null and empty texts, and those whose tokens do not spell them, have no
tokens, zeros everywhere; repeated rows and ids count as documents of their own; texts of
any length are aligned whole; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import bounded
from .bpe import ByteLevelBPE, LibraryPieces, PieceEncoder, gathered, json_classes, ragged
from .storage import discard, new_path, written

#: Bytes of a text above which it is cut into ranges of as many bytes, and fragments composed in a task. Two rounds of FAN cover any text that a column holds.
CHUNK, FAN = 1 << 16, 256
#: Pairs of documents in a block, and links of a group from which its equal tokens are counted before they are paired.
BLOCK_PAIRS, LARGE = 1 << 20, 1 << 12
#: A pair's code is a * RADIX + b; tables hold it less CODE_BASE, in four bytes.
RADIX, CODE_BASE = 1 << 16, 1 << 31
#: Bytes of texts whose tokens are held at a time, rows of a batch of results, pieces in the cache of each tokenizer, and bytes of a part of a written file.
HELD_BYTES, RESULT_ROWS, PIECES, FILE_PART = 1 << 17, 64, 200_000, 8 << 20


class FewPieces(LibraryPieces):
    """The first tokenizer's pieces, with a smaller cache: a task holds two of them."""

    def number(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if self.known > PIECES:
            self._clear()
        return super().number(data, starts, lens)


class SentencePieces(PieceEncoder):
    """Ids of pieces of text by the sentencepiece library, each different piece once; an id of its own marks pieces that their tokens do not spell."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.spelled = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        if any("▁" in x.lstrip("▁") or ("\n" in x) for x in names):
            raise ValueError("pieces of this model go over words or lines")
        self.unfit = len(names)
        self.sizes = np.array([*map(len, self.spelled), 0], np.int64)
        self._clear()

    def number(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if self.known > PIECES:
            self._clear()
        return super().number(data, starts, lens)

    def _add(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        data, ends = raw[ragged(starts, lens)].tobytes(), np.cumsum(lens).tolist()
        pieces = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        # After a line's end nothing is put before a piece. The library's space and the line's end, two tokens, go.
        found = [x[2:] for x in self.library.encode(["\n" + p.decode() for p in pieces], num_threads=1)]
        found = [x if b"".join(map(self.spelled.__getitem__, x)) == p else [self.unfit] for x, p in zip(found, pieces, strict=True)]
        self._keep(np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text. No token goes over a space after something else, or a line's end: pieces between these are encoded apart."""
        raw = np.frombuffer(b"\xff".join(texts), np.uint8)
        space, line, apart = raw == 0x20, raw == 0x0A, raw == 0xFF
        start = line | apart
        start[1:] |= (space[1:] & ~space[:-1]) | line[:-1] | apart[:-1]
        start[:1] = True
        at = np.flatnonzero(start)
        lens = np.diff(np.append(at, len(raw)))
        word = ~apart[at]
        numbers = self.number(raw.tobytes(), at[word], lens[word])
        counts = self.counts(numbers)
        ids = self.ids(numbers, counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = total[np.cumsum(word)[~word]].tolist()
        for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
            yield ids[a:b]


class Aligner(NamedTuple):
    """Both tokenizers, the bytes of their tokens, and how their ids are written."""

    one: ByteLevelBPE
    two: SentencePieces
    sizes: np.ndarray
    shown: list[str]


@lru_cache(maxsize=1)
def aligner(one: str, two: str, classes: bytes) -> Aligner:
    codec = ByteLevelBPE.from_json(one, classes)
    codec.specials, codec.encoder = {}, FewPieces(codec.encoder.model)
    pieces = SentencePieces(two)
    return Aligner(codec, pieces, np.array([*map(len, codec.tokens)], np.int64), [f"{i}{mark}" for i in range(max(len(codec.tokens), pieces.unfit)) for mark in ",|;"])


class Tokens(NamedTuple):
    """Ids of both sides and the offsets where they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def part(self, i: int, j: int, k: int, m: int) -> Tokens:
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


class Closed(NamedTuple):
    """Groups of a stretch: how many, their tokens and links, how they are written, and each pair of ids with its links."""

    n_groups: int
    n_a: int
    n_b: int
    n_links: int
    written: bytes
    codes: np.ndarray
    times: np.ndarray


class Fragment(NamedTuple):
    """joined: it has a common end. Without one all its tokens are its prefix."""

    fits: bool
    joined: bool
    prefix: Tokens
    closed: Closed
    suffix: Tokens


NOTHING = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))
NO_GROUPS = Closed(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
#: What tokens do not spell. Nothing composed with it is spelled.
UNFIT = Fragment(False, False, NOTHING, NO_GROUPS, NOTHING)


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each is there."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - 1))
    return keys[order[first]], np.add.reduceat(times[order], first) if len(first) else times[:0]


def close(t: Tokens, edges: np.ndarray, shown: list[str]) -> list[Closed]:
    """The groups of each of some stretches that end at the edges, which are common ends."""
    a_last, b_last = (np.isin(x, y, assume_unique=True) for x, y in ((t.a_ends, t.b_ends), (t.b_ends, t.a_ends)))
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    ends = t.a_ends[a_last]
    n = len(ends)
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    owner = np.searchsorted(edges, ends)
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    each = np.where(links > LARGE, 0, n_b)[a_group]
    left = np.repeat(np.arange(len(t.a)), each)
    right = b_first[a_group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    keys, times = counted((owner[a_group[left]] << 32) | (t.a[left] * RADIX + t.b[right]))
    large = np.flatnonzero(links > LARGE)
    if len(large):
        more = []
        for g in large.tolist():
            (x, m), (y, k) = counted(t.a[a_first[g] : a_first[g] + n_a[g]]), counted(t.b[b_first[g] : b_first[g] + n_b[g]])
            more.append((((owner[g] << 32) | (x[:, None] * RADIX + y)).ravel(), (m[:, None] * k).ravel()))
        keys, times = counted(np.concatenate([keys, *(x for x, _ in more)]), np.concatenate([times, *(x for _, x in more)]))
    # Each group's tokens of one side, then those of the other; a mark after each tells what comes.
    line, marks = np.empty(len(t.a) + len(t.b), np.int64), 3 * t.a + a_last
    line[np.arange(len(t.a)) + b_first[a_group]] = marks
    line[np.arange(len(t.b)) + (a_first + n_a)[b_group]] = 3 * t.b + 2 * b_last
    names = [shown[i] for i in line.tolist()]
    k = len(edges)
    a_to, b_to, g_to = (np.searchsorted(x, edges, side="right") for x in (t.a_ends, t.b_ends, ends))
    p_to = np.searchsorted(keys, np.arange(1, k + 1) << 32)
    sums = np.concatenate([[0], np.cumsum(links)])
    codes = keys & 0xFFFFFFFF
    out, a0, b0, g0, p0 = [], 0, 0, 0, 0
    for a, b, g, p in zip(a_to.tolist(), b_to.tolist(), g_to.tolist(), p_to.tolist(), strict=True):
        out.append(Closed(g - g0, a - a0, b - b0, int(sums[g] - sums[g0]), "".join(names[a0 + b0 : a + b]).encode(), codes[p0:p], times[p0:p]))
        a0, b0, g0, p0 = a, b, g, p
    return out


def together(x: Closed, y: Closed) -> Closed:
    if not x.n_groups or not y.n_groups:
        return x if x.n_groups else y
    codes, times = counted(np.concatenate([x.codes, y.codes]), np.concatenate([x.times, y.times]))
    return Closed(*(p + q for p, q in zip(x[:5], y[:5], strict=True)), codes, times)


def closed(t: Tokens, shown: list[str]) -> Closed:
    return close(t, t.a_ends[-1:], shown)[0] if len(t.a) else NO_GROUPS


def fragment(t: Tokens, shown: list[str]) -> Fragment:
    """Of neighbouring tokens, however their sides are cut."""
    both = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True)
    if not len(both):
        return Fragment(True, False, t, NO_GROUPS, NOTHING)
    (i, j), (k, m) = ([int(np.searchsorted(x, y, side="right")) for y in (both[0], both[-1])] for x in (t.a_ends, t.b_ends))
    return Fragment(True, True, t.part(0, i, 0, k), closed(t.part(i, j, k, m), shown), t.part(j, None, m, None))


def compose(x: Fragment, y: Fragment, shown: list[str]) -> Fragment:
    """The fragment of both stretches, the second right after the first. Associative; what is open between them is closed where common ends show up."""
    inner = Tokens(*(np.concatenate(c) for c in zip(x.suffix if x.joined else x.prefix, y.prefix, strict=True)))
    if not x.fits or not y.fits:
        return UNFIT
    if x.joined and y.joined:
        return Fragment(True, True, x.prefix, together(together(x.closed, closed(inner, shown)), y.closed), y.suffix)
    f = fragment(inner, shown)
    if x.joined:
        if not f.joined:
            return x._replace(suffix=inner)
        return Fragment(True, True, x.prefix, together(together(x.closed, closed(f.prefix, shown)), f.closed), f.suffix)
    if y.joined:
        return Fragment(True, True, f.prefix, together(f.closed, y.closed), y.suffix)
    return f


def tree(fragments: list[Fragment], shown: list[str]) -> Fragment:
    """Composed by halves."""
    while len(fragments) > 1:
        fragments = [compose(*pair, shown) if len(pair) > 1 else pair[0] for pair in (fragments[i : i + 2] for i in range(0, len(fragments), 2))]
    return fragments[0]


def whole(f: Fragment, shown: list[str]) -> Closed:
    """The groups of a whole text: its start closes the prefix."""
    if not f.fits or len(f.suffix.a) + len(f.suffix.b):
        return NO_GROUPS
    return together(closed(f.prefix, shown), f.closed) if f.joined else NO_GROUPS


def ends_of(ids: list[np.ndarray], sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each token ends, of stretches that start at the given offsets."""
    n = np.array([len(x) for x in ids], np.int64)
    size = sizes.take(np.concatenate(ids))
    through = np.cumsum(size)
    before = np.concatenate([[0], through])[np.cumsum(n) - n]
    return through + np.repeat(starts - before, n)


def spans(texts: list[bytes], worker: Aligner) -> Iterator[tuple[list[int], Tokens, np.ndarray]]:
    """For groups of texts the numbers of those that tokens spell, their tokens one text after the other, and where each text ends."""
    for group in gathered(texts, HELD_BYTES):
        numbers, some = [k for k, _ in group], [x for _, x in group]
        a, b = list(worker.one.encode(some)), list(worker.two.encode(some))
        good = [i for i, (x, y) in enumerate(zip(some, b, strict=True)) if len(x) and not (y == worker.two.unfit).any()]
        if not good:
            continue
        sizes = np.array([len(some[i]) for i in good], np.int64)
        edges = np.cumsum(sizes)
        a, b = [a[i] for i in good], [b[i] for i in good]
        yield [numbers[i] for i in good], Tokens(np.concatenate(a).astype(np.int64), ends_of(a, worker.sizes, edges - sizes), np.concatenate(b).astype(np.int64), ends_of(b, worker.two.sizes, edges - sizes)), edges


def align_texts(texts: list[bytes | None], worker: Aligner) -> list[Closed]:
    """Groups of each whole text, a space before it."""
    out = [NO_GROUPS] * len(texts)
    for numbers, tokens, edges in spans([b" " + t if t else b"" for t in texts], worker):
        for k, x in zip(numbers, close(tokens, edges, worker.shown), strict=True):
            out[k] = x
    return out


# Where each tokenizer has a boundary whatever stands around: one of them at words' ends, the other before a space after something else and around lines' ends.
_CUT_ONE = re.compile(rb"(?<=[A-Za-z0-9])(?=[\x09-\x0d\x20.,;:!?)])")
_CUT_TWO = re.compile(rb"(?<=[^\x20])(?=\x20)|(?<=\n)|(?=\n)")


def ranges(text: bytes, cut: re.Pattern, size: int) -> list[tuple[int, int]]:
    """A byte range for each stretch of ``size`` bytes: from its first boundary to that of the next one."""
    edges = [0]
    for at in range(size, len(text), size):
        found = cut.search(text, max(at, edges[-1]))
        edges.append(found.start() if found else len(text))
    return list(zip(edges, [*edges[1:], len(text)], strict=True))


def range_fragment(a: bytes, a_at: int, b: bytes, b_at: int, worker: Aligner) -> Fragment:
    """The fragment of a range of each side."""
    x, y = next(iter(worker.one.encode([a]))), next(iter(worker.two.encode([b])))
    if (y == worker.two.unfit).any():
        return UNFIT
    return fragment(Tokens(x.astype(np.int64), ends_of([x], worker.sizes, np.array([a_at])), y.astype(np.int64), ends_of([y], worker.two.sizes, np.array([b_at]))), worker.shown)


_OPEN = "_a array<long>, _a_ends array<long>, _b array<long>, _b_ends array<long>"
_GROUPS = "n_groups long, n_a long, n_b long, n_links long, written binary, codes array<long>, times array<long>"
_FRAGMENT = ", ".join(["row long", "k int", "_key {key}", "fits boolean", "joined boolean", _OPEN.replace("_", "p_", 1).replace(" _", " p_"), _GROUPS, _OPEN.replace("_", "s_", 1).replace(" _", " s_")])
_ALIGNED = "_key {key}, n_groups long, n_a long, n_b long, n_links long, groups_sha256 string, block long, codes array<int>, times array<long>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str, key: pa.DataType) -> pa.Schema:
    return pa.schema([(n, key if k == "{key}" else _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _row(f: Fragment) -> tuple:
    return (f.fits, f.joined, *f.prefix, *f.closed, *f.suffix)


def _fragments(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, object, Fragment]]:
    """(row, k, key, fragment) of each row."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns]
    for i in range(batch.num_rows):
        row, k, key, fits, joined, *rest = (c[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[i].as_py() for c in columns)
        yield row, k, key, Fragment(fits, joined, Tokens(*rest[:4]), Closed(*rest[4:11]), Tokens(*rest[11:]))


def long_fragments(docs: DataFrame, one: str, two: str, classes: bytes, key: pa.DataType, kind: str) -> DataFrame:
    """A fragment for each (_key, _text) of long texts: ranges of bytes dealt to tasks, then FAN neighbours composed at a time."""
    chunk, fan = CHUNK, FAN
    cut = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("_key", key), ("a_at", pa.int64()), ("a", pa.binary()), ("b_at", pa.int64()), ("b", pa.binary())])
    shape = _schema(_FRAGMENT, key)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                whole_text = b" " + text.as_py()
                for k, ((a, b), (c, d)) in enumerate(zip(ranges(whole_text, _CUT_ONE, chunk), ranges(whole_text, _CUT_TWO, chunk), strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, k, name, a, whole_text[a:b], c, whole_text[c:d]), cut.types, strict=True)], schema=cut)
                row += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(one, two, classes)
        for batch in batches:
            for x in (x for part in (batch.slice(i, 1) for i in range(batch.num_rows)) for x in part.to_pylist()):
                found = range_fragment(x["a"], x["a_at"], x["b"], x["b_at"], worker)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((x["row"], x["k"], x["_key"], *_row(found)), shape.types, strict=True)], schema=shape)

    def reduce(table: pa.Table) -> pa.Table:
        worker = aligner(one, two, classes)
        found = sorted(_fragments(table), key=lambda x: x[1])
        row, k, name, _ = found[0]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((row, k // fan, name, *_row(tree([f for *_, f in found], worker.shown))), shape.types, strict=True)], schema=shape)

    rows = docs.mapInArrow(cut_up, f"row long, k int, _key {kind}, a_at long, a binary, b_at long, b binary").repartition("row", "k")
    out = rows.mapInArrow(encode, _FRAGMENT.format(key=kind))
    for _ in range(2):
        out = out.groupBy("row", F.floor(F.col("k") / fan)).applyInArrow(reduce, _FRAGMENT.format(key=kind))
    return out


def aligned(docs: DataFrame, one: str, two: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, counts of groups, tokens and links, digest of the groups, block, codes, times) of every row; a code is a pair of ids, times its links."""
    classes = json_classes(one)
    kept = bounded(docs).select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = kept.schema["_key"].dataType.simpleString()
    key = kept.limit(0).toArrow().schema.field("_key").type
    shape = _schema(_ALIGNED, key)
    most = BLOCK_PAIRS

    def rows(keys: list, found: list[Closed], block: int) -> pa.RecordBatch:
        digest = [hashlib.sha256(x.written[:-1]).hexdigest() if x.n_groups else "" for x in found]
        columns = [keys, *([x[i] for x in found] for i in range(4)), digest, [block] * len(keys), [(x.codes - CODE_BASE).astype(np.int32) for x in found], [x.times for x in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, block, held = aligner(one, two, classes), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in (batch.slice(i, RESULT_ROWS) for i in range(0, batch.num_rows, RESULT_ROWS)):
                found = align_texts(part.column(1).cast(pa.binary()).to_pylist(), worker)
                yield rows(part.column(0).to_pylist(), found, block)
                held += sum(len(x.codes) for x in found)
                if held >= most:
                    block, held = block + 1, 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(one, two, classes)
        for batch in batches:
            for row, _, name, f in _fragments(batch):
                yield rows([name], [whole(f, worker.shown)], -1 - row)

    is_long = F.coalesce(F.octet_length("_text") > CHUNK, F.lit(False))
    some = kept.where(~is_long).mapInArrow(short, _ALIGNED.format(key=kind))
    return some.unionAll(long_fragments(kept.where(is_long), one, two, classes, key, kind).mapInArrow(finish, _ALIGNED.format(key=kind)))


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, code, n): how many documents of a block hold a pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            codes = batch.column("codes")
            owner = np.repeat(block, codes.value_lengths().to_numpy())
            flat = codes.flatten().to_numpy()
            for b in np.unique(block).tolist():
                found, n = np.unique(flat[owner == b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(found), pa.array(n.astype(np.int64))], ["block", "code", "n"])

    return rows.select("block", "codes").mapInArrow(run, "block long, code int, n long").groupBy("block", "code").agg(F.sum("n").alias("n"))


def pair_counts(per_block: DataFrame) -> DataFrame:
    """(code, count, best): documents that hold a pair linked, and whether that is the most of the pairs of its first id."""
    counts = per_block.groupBy("code").agg(F.sum("n").alias("count"))
    first = F.floor((F.col("code").cast("long") + CODE_BASE) / RADIX)
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(first)))


def alignment(docs: DataFrame, one: str, two: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    paths = [new_path(spark, name) for name in ("aligned", "block-pairs")]
    rows = written(aligned(docs, one, two, id_col, text_col), "aligned", paths[0], FILE_PART)
    per_block = written(block_pairs(rows), "block-pairs", paths[1], FILE_PART)
    facts = per_block.join(pair_counts(per_block), "code").select("block", "code", "count", "best")
    kind = rows.schema["_key"].dataType.simpleString()

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        code, count, best = (right.column(c).to_numpy() for c in ("code", "count", "best"))
        order = np.argsort(code)
        codes, times = (left.column(c).combine_chunks() for c in ("codes", "times"))
        at = order[np.searchsorted(code, codes.flatten().to_numpy(), sorter=order)] if len(code) else np.zeros(0, np.int64)
        n = times.flatten().to_numpy()
        ends = np.cumsum(codes.value_lengths().to_numpy())
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n * best[at], n * count[at])]
        starts = ends - codes.value_lengths().to_numpy()
        out = {c: left.column(c) for c in ("_key", "n_a", "n_b", "n_groups", "n_links")}
        out |= {c: pa.array((s[ends] - s[starts]).astype(np.int64)) for c, s in zip(("n_best", "count_sum"), sums, strict=True)}
        return pa.table(out | {"groups_sha256": left.column("groups_sha256")})

    found = rows.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(add_up, f"_key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    out = written(found.withColumnRenamed("_key", id_col), "alignment")
    for path in paths:
        discard(spark, path)
    return out
