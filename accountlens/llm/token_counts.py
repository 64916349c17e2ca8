"""Token counts by a compiled finite-state tokenizer.

The tokenizer is compiled into a cascade of two deterministic transducers. The
first reads characters; its transitions are annotated with what they emit: the
start of a word, or nothing. It runs in chunks side by side, whose state maps
compose through a parallel prefix scan (:mod:`.scan`). The second reads the bytes
of words and emits numbers of tokens (:mod:`.transducer`); as it is at its start
after every word, the map of a chunk that begins with a word is constant, and chunks
run side by side without one. Counts add up per document; no ids are kept.

Defined cases: null and empty texts have 0 tokens; special strings inside a text
count as one token each, as the library takes them by default; texts of any length
are counted whole; equal texts count the same; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .batches import map_texts
from .scan import TransitionScan
from .transducer import compiled

# A letter that str.lower takes by its place in a word.
SIGMA = ("\u03a3", "\u03c3")

FRESH, IN_LETTERS, IN_OTHERS, ONE_LEFT, TWO_LEFT = range(5)


@lru_cache(maxsize=1)
def _word_transducer() -> tuple[TransitionScan, np.ndarray]:
    """The scan, and what a transition emits (1: a word starts), by symbol and state. White space belongs to no word."""
    delta, emits = np.zeros((9, 5), np.int64), np.zeros((9, 5), bool)
    for state in (FRESH, IN_LETTERS, IN_OTHERS):
        delta[bpe.S_LETTER, state], emits[bpe.S_LETTER, state] = IN_LETTERS, state != IN_LETTERS
        delta[bpe.S_NUMBER, state], emits[bpe.S_NUMBER, state] = FRESH, True
        delta[bpe.S_OTHER, state], emits[bpe.S_OTHER, state] = IN_OTHERS, state != IN_OTHERS
        for symbol, left in ((bpe.S_SHORT, ONE_LEFT), (bpe.S_LONG, TWO_LEFT)):
            inside = state == IN_OTHERS
            delta[symbol, state], emits[symbol, state] = (IN_OTHERS, False) if inside else (left, True)
    delta[:, ONE_LEFT], delta[:, TWO_LEFT] = FRESH, ONE_LEFT
    for symbol in (bpe.S_INNER, bpe.S_END):
        delta[symbol, :] = FRESH
    return TransitionScan(delta), emits.ravel()


def words(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of normalised texts that stand between separators; the text of each word."""
    scan, emits = _word_transducer()
    symbol, first, at = bpe.characters(data, table)
    marked = bpe.mark_contractions(symbol, first)
    keep = np.ones(len(symbol), bool)
    np.not_equal(symbol[1:], symbol[:-1], out=keep[1:])
    keep |= (symbol == bpe.S_END) | (symbol == bpe.S_NUMBER)
    for i in (1, 2, 3):
        keep[np.minimum(marked + i, len(symbol) - 1)] = True
    some = np.flatnonzero(keep)
    read = symbol[some]
    emitted = emits.take(read.astype(np.intp) * 5 + scan.states_before(read))
    gap = (read == bpe.S_INNER) | (read == bpe.S_END)
    edge = np.flatnonzero(emitted | gap)  # a word ends where the next one, or white space, begins
    begin = some[edge] if at is None else at[some[edge]]
    lens = np.diff(np.append(begin, len(data)))
    word = emitted[edge]
    return begin[word], lens[word], np.cumsum(read[edge] == bpe.S_END)[word]


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Code points that Python does not know yet."""
    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


class TokenCounter:
    def __init__(self, vocabulary: str, classes: bytes | None = None):
        from tokenizers import Tokenizer

        spec = bpe.read_json(vocabulary)
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.machine = compiled(spec["model"], bpe.byte_characters())
        self.table = bpe.class_table(classes)
        self.normalizer = Tokenizer.from_file(vocabulary).normalizer

    def normalise(self, text: bytes) -> bytes:
        """NFC, then lower case letter by letter. White space is left: it ends words, one or many. What Python does not know goes to the library."""
        if text.isascii():
            return text.lower()
        s = text.decode("utf-8", "replace")
        if _unassigned().take(np.frombuffer(s.encode("utf-32-le"), np.uint32)).any():
            return self.normalizer.normalize_str(s).encode()
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        return s.replace(*SIGMA).lower().encode()

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts: list[bytes] = []
        owners: list[int] = []
        for k, text in enumerate(texts):
            text = text or b""
            if any(s in text for s in self.specials):
                split = bpe.split_specials(text, self.specials)
                out[k] += len(split) // 2
                parts += split[::2]
                owners += [k] * len(split[::2])
            else:
                parts.append(text)
                owners.append(k)
        for group in bpe.gathered(parts):
            data = b"\xff".join(self.normalise(x) for _, x in group)
            if data:
                starts, lens, of = words(data, self.table)
                counts = self.machine.counts(data, starts, lens)
                per = np.bincount(of, counts, minlength=len(group)).astype(np.int64)
                np.add.at(out, np.array([owners[j] for j, _ in group]), per)
        return out


@lru_cache(maxsize=1)
def counter_of(vocabulary: str, classes: bytes | None = None) -> TokenCounter:
    return TokenCounter(vocabulary, classes)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""

    classes = bpe.json_classes(vocabulary)

    def run(counter: TokenCounter, texts: list) -> list:
        return [[len(t or b"") for t in texts], counter.count(texts)]

    out = map_texts(docs, id_col, text_col, run, "n_bytes long, n_tokens long", worker=lambda: counter_of(vocabulary, classes))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
