"""Spelling variants: words one edit apart, and the frequent form that each stands for.

Words are vectors of letter counts. One edit changes the squared distance of two
vectors to at most two, so pairs come from Gram matrices of blocks: a block holds
words of one length and one split of their letters into CLASSES classes, and meets
only blocks of its own and the next length whose split is an edit away. Products of
two blocks' counts give all squared distances; pairs that pass are compared letter by
letter. A pair of blocks sends on one row a word: how many are near, and the best.

Defined cases: null and empty texts have no words; a null id counts as an empty one;
repeated rows and ids count each; texts and words of any length are taken whole; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, parts
from .simhash import with_hot
from .storage import checkpointed, discard, new_path, written

#: Classes of letters, by their code points, and words and letters of a block.
CLASSES, BLOCK, BLOCK_LETTERS = 6, 768, 1 << 19
#: Of the occurrences of words, one in this many loses a letter.
WORN = 199
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def occurrences(text: bytes, doc_id: bytes, least: int) -> Counter:
    """Words of a text as they occur, by UTF-8: lower-case runs of letters, some of them with a letter lost."""
    out: Counter = Counter()
    start = zlib.crc32(doc_id + b":")
    for run, n in Counter(_RUN.findall(text.lower())).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run, start)
        if h % WORN == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def words(docs: DataFrame, least_letters: int, least_times: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the different words and their occurrences, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                total: Counter = Counter()
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                    if text.is_valid:
                        total.update(occurrences(text.as_py(), (i or "").encode(), least_letters))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    kept = bounded(docs).select(F.col(f"`{id_col}`").cast("string").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = kept.mapInArrow(run, "word string, n long").where(F.length("word") >= least_letters)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def with_cells(rows: DataFrame) -> DataFrame:
    """Rows with cell, the number of letters of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            sizes = np.array([*map(len, texts)], np.int64)
            kind = np.frombuffer(b"".join(texts), np.uint8) % CLASSES
            owner = np.repeat(np.arange(len(texts)), sizes)
            counts = np.bincount(owner * CLASSES + kind, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([" ".join(map(str, c)) for c in counts.tolist()], pa.string())], ["word", "n", "cell"])

    return rows.select("word", "n").mapInArrow(run, "word string, n long, cell string")


def partners(cell: str) -> list[str]:
    """The cells that an edit leads to, of each two the one: itself, a letter replaced, a letter more."""
    counts = [int(c) for c in cell.split(" ")]

    def moved(lost: int, won: int) -> str:
        return " ".join(str(c - (i == lost) + (i == won)) for i, c in enumerate(counts))

    replaced = [moved(i, j) for i in range(CLASSES) if counts[i] for j in range(i + 1, CLASSES)]
    return [cell, *replaced, *(moved(-1, j) for j in range(CLASSES))]


def block_pairs(rows: DataFrame) -> DataFrame:
    """(one, one_n, two, two_n, size, longer, itself): pairs of blocks whose words may be near, each block's words joined to one string."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, n = batch.column("cell").to_pylist(), batch.column("chunks")
            found = [partners(c) for c in cells]
            times = [len(x) for x in found]
            owner = pa.array(np.repeat(np.arange(len(cells)), times))
            yield pa.RecordBatch.from_arrays([batch.column("cell").take(owner), n.take(owner), pa.array([y for x in found for y in x], pa.string())], ["cell", "chunks", "two_cell"])

    sized = with_cells(rows)
    size = F.aggregate(F.split("cell", " "), F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))
    cells = checkpointed(sized.groupBy("cell").agg(F.count("*").alias("_rows")).withColumn("chunks", F.greatest(F.ceil(F.col("_rows") / BLOCK), F.ceil(F.col("_rows") * size / BLOCK_LETTERS))))
    n_rows = cells.agg(F.sum("_rows")).first()[0] or 0
    dealt = with_hot(sized, cells, "cell", n_rows).withColumn("chunk", F.pmod(F.xxhash64("word"), "chunks"))
    one = F.array_sort(F.collect_list(F.struct("word", "n")))
    blocks = checkpointed(dealt.groupBy("cell", "chunk").agg(one.alias("w")).select("cell", "chunk", F.array_join(F.col("w.word"), "").alias("letters"), F.col("w.n").alias("n")))
    met = cells.select("cell", "chunks").mapInArrow(meet, "cell string, chunks long, two_cell string")
    met = met.join(cells.select(F.col("cell").alias("two_cell"), F.col("chunks").alias("two_chunks")), "two_cell")
    met = met.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("two_chunk", F.explode(F.sequence(F.lit(0), F.col("two_chunks") - 1)))
    met = met.where((F.col("cell") != F.col("two_cell")) | (F.col("chunk") <= F.col("two_chunk")))
    left = blocks.select("cell", "chunk", F.col("letters").alias("one"), F.col("n").alias("one_n"))
    right = blocks.select(F.col("cell").alias("two_cell"), F.col("chunk").alias("two_chunk"), F.col("letters").alias("two"), F.col("n").alias("two_n"))
    both = met.join(left, ["cell", "chunk"]).join(right, ["two_cell", "two_chunk"])
    longer = F.length("two") / F.size("two_n") > F.length("one") / F.size("one_n")
    return both.select("one", "one_n", "two", "two_n", longer.alias("longer"), ((F.col("cell") == F.col("two_cell")) & (F.col("chunk") == F.col("two_chunk"))).alias("itself"))


def close_pairs(one: np.ndarray, two: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters one edit apart, of two blocks of equal length or the second a letter longer."""
    used = np.flatnonzero(np.bincount(one.ravel(), minlength=256) + np.bincount(two.ravel(), minlength=256))
    column = np.zeros(256, np.int64)
    column[used] = np.arange(len(used))
    real = np.float32 if one.shape[1] < 2048 else np.float64

    def counts(x: np.ndarray) -> np.ndarray:
        place = column[x] + (np.arange(len(x)) * len(used))[:, None]
        return np.bincount(place.ravel(), minlength=len(x) * len(used)).reshape(len(x), -1).astype(real)

    x = counts(one)
    y = x if itself else counts(two)
    squares = (x * x).sum(1)[:, None] + ((y * y).sum(1)[None, :] - 2 * (x @ y.T))
    longer = two.shape[1] - one.shape[1]
    i, j = np.nonzero(squares == (1 if longer else 2))
    if itself:
        i, j = i[i < j], j[i < j]
    same = one[i] == two[j][:, : one.shape[1]]
    if not longer:
        good = (~same).sum(1) == 1
    else:
        # The shared start and the shared end cover the shorter word.
        start = np.where(same.all(1), one.shape[1], np.argmin(same, 1))
        back = one[i] == two[j][:, 1:]
        end = np.where(back.all(1), one.shape[1], np.argmin(back[:, ::-1], 1))
        good = start + end >= one.shape[1]
    return i[good], j[good]


def best_of(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, how many are near each, the near one of largest n, the first of ties)."""
    order = np.lexsort((j, -n[j], i))
    first = np.flatnonzero(np.diff(i[order], prepend=-1))
    return i[order[first]], np.diff(np.append(first, len(i))), j[order[first]]


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): for words with near ones, their number and the one of largest n, ties to the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one_n, two_n = batch.column("one_n"), batch.column("two_n")
            for k, (a, b, itself) in enumerate(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), batch.column("itself").to_pylist(), strict=True)):
                n, m = one_n[k].values.to_numpy(), two_n[k].values.to_numpy()
                one, two = (np.frombuffer(x.encode("latin-1"), np.uint8).reshape(len(y), -1) for x, y in ((a, n), (b, m)))
                i, j = close_pairs(one, two, itself)
                if not len(i):
                    continue
                for mine, other, x, y, count in ((i, j, one, two, m), (j, i, two, one, n)):
                    if itself and mine is j:
                        continue
                    if itself:
                        mine, other = np.concatenate([i, j]), np.concatenate([j, i])
                    word, near, best = best_of(mine, other, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.tobytes().decode("latin-1") for r in x[word]]), pa.array(near.astype(np.int64)), pa.array(count[best]), pa.array([r.tobytes().decode("latin-1") for r in y[best]])],
                        ["word", "n_near", "form_n", "form"],
                    )

    found = block_pairs(rows).mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms that follow. Each round doubles the steps; a form is more frequent by a factor, so chains are short."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = 6, least_times: int = 5, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: the near word of largest n is its form, if that is ``factor`` times its own."""
    spark = docs.sparkSession
    path = new_path(spark, "words")
    rows = written(words(docs, least_letters, least_times, id_col, text_col), "words", path)
    enough = F.col("form_n") >= factor * F.col("n")
    marked = checkpointed(rows.join(near_words(rows), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    discard(spark, path)
    out = marked.join(roots(marked.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
