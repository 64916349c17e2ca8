"""C06 by a trained model: the language of a text from the letters that follow each other in it.

Runs of one to three letters are hashed to buckets; a language's model is the log
probability of each bucket among its own texts. Counting is a Spark aggregate with
partial sums; the model is a matrix of a fixed size, so it is held by every task; texts
are scored in Arrow batches. Like C06 it reads the first 400 characters and says nothing
of texts under 40.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are read, letters from which a text is judged, buckets, and languages that a model may have.
READ, LEAST, BUCKETS, LANGUAGES = 400, 40, 1 << 15, 256
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # a row of log probabilities for each language


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all runs of one to three letters of the texts, blanks being one letter."""
    shown = [" " + " ".join((t or "").split())[:READ].casefold() + " " for t in texts]
    sizes = np.array([len(t) for t in shown], np.int64)
    letters = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.where((letters >= 48) & (letters <= 57), np.uint64(48), letters)  # digits are one letter
    owners, found, h = [], [], np.zeros(len(letters), np.uint64)
    for n, factor in enumerate(_FACTORS):
        h = (h[: len(letters) - n] if n else h) * _FACTORS[0] + letters[n:] * factor
        whole = owner[: len(h)] == owner[n:]
        mixed = h ^ (h >> np.uint64(29))
        found.append((mixed * _FACTORS[1] >> np.uint64(64 - BUCKETS.bit_length() + 1))[whole].astype(np.int64))
        owners.append(owner[: len(h)][whole])
        h = h[: len(h) - 1] if len(h) else h
    return np.concatenate(owners), np.concatenate(found)


def train(docs: DataFrame, text: str = "text", language: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Counted over all rows that have a language. The driver gets LANGUAGES * BUCKETS sums at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, which = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            owner, bucket = buckets(batch.column(0).to_pylist())
            keys, n = np.unique(which[owner] * BUCKETS + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[keys // BUCKETS].tolist(), pa.string()), pa.array(keys % BUCKETS), pa.array(n.astype(np.int64))], ["language", "bucket", "n"])

    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(language).cast("string").alias("l"))
    known = sorted(r.l for r in rows.select("l").distinct().limit(LANGUAGES + 1).collect())
    if len(known) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    sums = rows.mapInArrow(run, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(known), BUCKETS))
    counts[np.searchsorted(known, sums["language"].to_numpy(str)) if len(sums) else [], sums["bucket"].to_numpy(int)] = sums["n"]
    return LanguageModel(known, np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)).astype(np.float32))


def identify(texts: list[str | None], model: LanguageModel) -> list[str | None]:
    """The likeliest language of each text; None for those that are too short or without a letter."""
    if not model.languages or not texts:
        return [None] * len(texts)
    owner, bucket = buckets(texts)
    scores = np.array([np.bincount(owner, weights=w[bucket], minlength=len(texts)) for w in model.weights])
    best = scores.argmax(0).tolist()
    return [model.languages[k] if t is not None and len(t.strip()) >= LEAST and any(map(str.isalpha, t[: 2 * READ])) else None for t, k in zip(texts, best, strict=True)]


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", to: str = "language") -> DataFrame:
    """Rows with a column of the text's language; where the rows have that column, known ones stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def find(batch):
        import pandas as pd

        return pd.Series(identify([t if isinstance(t, str) else None for t in batch.tolist()], held.value), dtype=object)

    found = find(F.col(text))
    return docs.withColumn(to, F.coalesce(F.col(to), found) if to in docs.columns else found)
