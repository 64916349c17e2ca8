"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into overlapping chunks (``2 * HALF`` bytes,
every ``HALF`` bytes) over the whole document; learned filters answer to each
chunk, each filter's answers are max-pooled over the document, and a logistic
layer combines them into one probability. A chunk is two halves, so the filters
are two matrix products of the halves, added with a shift: nothing is copied for
the overlap.

Fitted on the driver on at most ``SAMPLE_ROWS`` labelled rows, those of the
smallest hashes of their ids among texts of at most ``SAMPLE_BYTES`` bytes; the
model has a fixed size, whatever the corpus.

Defined cases: null and empty texts are one chunk of padding and get its score;
texts of any length are read whole, in blocks whose answers are pooled; equal texts
score the same; rows without a label are scored and not learned from; without any
labels every score is 1; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import filter_texts, map_texts

SAMPLE_ROWS, SAMPLE_BYTES = 3000, 4096
HALF, EMBED, FILTERS = 8, 6, 24
THRESHOLD = 0.3
BLOCK = 1 << 18


class ByteCNN:
    """Embedding (257 x EMBED; 256 is padding), filters over 2 * HALF bytes, weights of the pooled answers."""

    def __init__(self, embed, filters, bias, weights, intercept):
        self.embed, self.filters, self.bias, self.weights, self.intercept = embed, filters, bias, weights, intercept

    @classmethod
    def fresh(cls, seed: int = 0) -> ByteCNN:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        embed[256] = 0
        filters = rng.normal(0, (2 * HALF * EMBED) ** -0.5, (2 * HALF * EMBED, FILTERS)).astype(np.float32)
        return cls(embed, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.float32(0))

    def _answers(self, halves: np.ndarray) -> np.ndarray:
        """Of each chunk: half i and half i + 1. halves: (n, HALF) of byte numbers; returns (n - 1, FILTERS) before bias and ReLU."""
        both = np.concatenate([self.filters[: HALF * EMBED], self.filters[HALF * EMBED :]], axis=1)
        out = self.embed.take(halves, axis=0).reshape(len(halves), HALF * EMBED) @ both
        return out[:-1, :FILTERS] + out[1:, FILTERS:]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, FILTERS): the largest answer of each filter over all chunks of each text."""
        out = np.full((len(texts), FILTERS), -np.inf, np.float32)
        group: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for a in range(0, max(len(text), 1), BLOCK):  # parts of a long text overlap by a half
                group.append((k, text[a : a + BLOCK + HALF]))
                size += len(group[-1][1])
                if size >= BLOCK:
                    self._pool(group, out)
                    group, size = [], 0
        if group:
            self._pool(group, out)
        return np.maximum(out + self.bias, 0)

    def _pool(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        halves, starts = layout([x for _, x in group])
        answers = self._answers(halves)
        most = np.maximum.reduceat(answers, np.column_stack([starts[:-1], starts[1:] - 1]).ravel()[:-1], axis=0)[::2]  # no chunk spans two texts
        np.maximum.at(out, np.array([k for k, _ in group]), most)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = self.pooled(texts).astype(np.float64) @ self.weights.astype(np.float64) + float(self.intercept)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in halves, each padded to at least two, and where each text's halves start."""
    counts = np.array([max(2, -(-len(t) // HALF)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(int(starts[-1]) * HALF, 256, np.int16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts])
    shift = np.repeat(starts[:-1] * HALF - (np.cumsum(lens) - lens), lens)
    flat[shift + np.arange(len(data))] = data
    return flat.reshape(-1, HALF), starts


def fit(texts: list[bytes], labels: list[int], epochs: int = 14, rate: float = 0.02, seed: int = 0) -> ByteCNN:
    """Adam on the log loss. Only the chunk that gives a filter's maximum passes its gradient on."""
    net = ByteCNN.fresh(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        net.weights[:] = 0
        net.intercept = np.float32(-6 if len(y) and y.max() == 0 else 40)
        return net
    net.intercept = np.float32(np.log(y.mean() / (1 - y.mean())))
    rng, step = np.random.default_rng(seed), 0
    params = {"embed": net.embed, "filters": net.filters, "bias": net.bias, "weights": net.weights, "intercept": np.array([net.intercept], np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            some = order[a : a + 64]
            halves, starts = layout([texts[i] for i in some])
            answers = net._answers(halves)
            at = np.empty((len(some), FILTERS), np.int64)
            for i in range(len(some)):
                at[i] = starts[i] + answers[starts[i] : starts[i + 1] - 1].argmax(axis=0)
            raw = answers[at, np.arange(FILTERS)] + net.bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(hidden @ net.weights + params["intercept"][0])))
            gz = (p - y[some]) / len(some)
            gh = (gz[:, None] * net.weights) * (raw > 0)
            chunk = np.concatenate([halves[at], halves[at + 1]], axis=2)  # (texts, filters, bytes)
            inputs = net.embed[chunk].reshape(len(some), FILTERS, -1)
            grad = {"weights": hidden.T @ gz + 1e-4 * net.weights, "intercept": np.array([gz.sum()], np.float32), "bias": gh.sum(0)}
            grad["filters"] = np.einsum("nfd,nf->df", inputs, gh)
            back = (gh[:, :, None] * net.filters.T[None]).reshape(len(some), FILTERS, 2 * HALF, EMBED)
            flat = chunk.reshape(-1)
            grad["embed"] = np.stack([np.bincount(flat, back[..., e].reshape(-1), minlength=257) for e in range(EMBED)], axis=1)
            grad["embed"][256] = 0
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.intercept = params["intercept"][0]
    return net


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether a row is kept from learning, by the checksum of its id; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteCNN:
    """Fits on the labelled rows that are not held out: SAMPLE_ROWS of them, by the hash of the id, at most."""
    known = labels.select(id_col, label_col).where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    # Twice as many, as some texts are too long; the sample is of a fixed size.
    picked = known.groupBy(id_col).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(2 * SAMPLE_ROWS)
    short = docs.select(id_col, F.col(text_col).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    rows = short.join(F.broadcast(picked), id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(id_col, "_text", "_label").collect()
    return fit([r["_text"].encode() for r in rows], [r["_label"] for r in rows])


def score(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(texts: list) -> list:
        return [net.probability([t or b"" for t in texts])]

    return map_texts(docs, id_col, text_col, run, "score double")


def keep(docs: DataFrame, net: ByteCNN, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores at least the threshold."""
    return filter_texts(docs, text_col, lambda texts: net.probability([t or b"" for t in texts]) >= threshold)
