"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is
parsed into phrases, each the longest match in that text that starts where the
phrase before ended; the number of phrases, normalised by log2 of the training
length over the document's length, estimates the bits a letter costs in that
language, and the language that needs fewest wins. All automata are one dense
table: a step that leaves the automaton goes on from its root and counts a phrase,
so a letter is one lookup, for many stretches of text side by side. A stretch is
read from the root first, and again from the state in which the one before it ends
until both runs are in one state, so the phrases are those of the whole text. The
``LETTERS`` most frequent letters are symbols of their own; any other letter, of
whatever script, is spelled by ``DIGITS`` more after an escape, so none are mixed up.

Learned on the driver from a sample of a fixed size: ``SAMPLE_SYMBOLS`` letters
over all languages, from ``SAMPLE_ROWS`` rows a language, by the hash of the id,
texts of up to ``SAMPLE_BYTES`` bytes
first (of longer ones at most 65,536 characters are sampled).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts
of any length are parsed whole; ties go to the language that comes first by name; with no labelled row
every text is ``und``; equal texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import filter_texts, map_texts

SAMPLE_SYMBOLS, SAMPLE_ROWS, SAMPLE_BYTES = 120_000, 60, 8192
LETTERS, DIGITS = 56, 3
STRETCH = 512
BLOCK = 1 << 20
UNDETERMINED = "und"
GAP, ESCAPE = 0, 1


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """(states, width) next state or -1 of the automaton of all substrings; state 0 is the root."""
    blank = array("i", [-1]) * width
    go, link, length, last = array("i", blank), [-1], [0], 0
    for c in symbols:
        new, p = len(link), last
        go.extend(blank)
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and go[p * width + c] < 0:
            go[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = go[p * width + c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(link)
                go.extend(go[q * width : (q + 1) * width])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p * width + c] == q:
                    go[p * width + c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.frombuffer(go, np.int32).reshape(-1, width)


class CrossParser:
    """samples: text of each language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = Counter(c for s in samples.values() for c in s.lower() if c.isalpha())
        self.alphabet = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.alphabet += [chr(i) for i in range(0xE000, 0xE000 + LETTERS - len(self.alphabet))]  # symbols that only spell
        self.width = LETTERS + 2
        self.symbols, self.spelling = _letters(tuple(self.alphabet))
        quota = SAMPLE_SYMBOLS // max(1, len(self.languages))
        tables, roots, self.log_size, base = [], [], [], 0
        for language in self.languages:
            text = self.compact([samples[language]])[0][:quota].tolist()
            go = suffix_automaton(text, self.width)
            alone = base + len(go)  # the state after a letter that the text does not have: a phrase of its own
            start = np.where(go[0] >= 0, base + go[0], alone)  # a step that leaves the automaton begins a phrase at its root
            table = np.where(go >= 0, (base + go) * (self.width * 2), start * (self.width * 2) + 1)
            table[0] = start * (self.width * 2)  # the first phrase of a stretch has begun
            tables.append(np.concatenate([table, start[None, :] * (self.width * 2) + 1]).astype(np.int32))
            roots.append(base * self.width)
            self.log_size.append(np.log2(len(text) + 2))
            base += len(go) + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.intp)
        self.log_size = np.array(self.log_size)

    def compact(self, texts: list[str], last: int = GAP) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, runs of gaps as one and none at the start, and how many each text has. last: the symbol before each text, where it goes on."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbols.take(cp)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        before = np.zeros(len(symbol), np.uint8)
        before[1:] = symbol[:-1]
        starts = np.cumsum(lens) - lens
        before[starts[lens > 0]] = last
        keep = (symbol != GAP) | (before != GAP)
        rare = symbol == ESCAPE
        total = np.concatenate([[0], np.cumsum(keep + rare * DIGITS)])
        n = total[starts + lens] - total[starts]
        out = symbol[keep]
        if rare.any():
            rare = np.flatnonzero(out == ESCAPE)
            out = np.insert(out, np.repeat(rare + 1, DIGITS), self.spelling[np.searchsorted(self.spelling[:, 0], cp[keep][rare]), 1:].ravel())
        return out, n

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(languages, texts) phrases, and symbols of each text. A text alone is read in windows, so that what it takes is bounded."""
        if len(texts) > 1 or not texts or len(texts[0]) <= BLOCK:
            return self._phrases(texts, GAP, None)[:2]
        counts, n, last, state = np.zeros((len(self.languages), 1), np.int64), np.zeros(1, np.int64), GAP, None
        for a in range(0, len(texts[0]), BLOCK):
            more, m, last, state = self._phrases([texts[0][a : a + BLOCK]], last, state)
            counts, n = counts + more, n + m
        return counts, n

    def _phrases(self, texts: list[str], last: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
        """phrases(), the last symbol and the states after it. before: the states in which the only text goes on, whose phrases so far are counted."""
        symbol, n = self.compact(texts, last)
        if not len(symbol):
            return np.zeros((len(self.languages), len(texts)), np.int64), n, last, before
        pieces = -(-n // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(n) - n, pieces) + nth * STRETCH
        lens = np.minimum(STRETCH, n[owner] - nth * STRETCH)
        order = np.argsort(-lens, kind="stable")
        starts, ordered = starts[order], lens[order]
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        if before is not None:
            state[:, np.flatnonzero(order == 0)[0]] = before
        trace = np.zeros((len(self.languages), len(symbol)), np.int32)  # what each step gave
        active = np.searchsorted(-ordered, -np.arange(int(ordered.max(initial=0))), side="left")
        for j, a in enumerate(active.tolist()):
            step = self.table.take(state[:, :a] + symbol.take(starts[:a] + j))
            trace[:, starts[:a] + j] = step
            state[:, :a] = step >> 1
        self._join(trace, symbol, np.cumsum(n) - n, n)
        total = np.concatenate([np.zeros((len(self.languages), 1), np.int64), np.cumsum(trace & 1, axis=1, dtype=np.int64)], axis=1)
        ends = np.cumsum(n)
        found = np.where(n > 0, total[:, ends] - total[:, ends - n] + (before is None), 0)
        return found, n, int(symbol[-1]), (trace[:, -1] >> 1).astype(np.intp)

    def _join(self, trace: np.ndarray, symbol: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Reads each stretch but a text's first again from the state before it, until it is in the state that it was in; as long as any end changes."""
        pieces = np.maximum(-(-n // STRETCH) - 1, 0)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        start = np.repeat(first, pieces) + nth * STRETCH
        end = np.minimum(start + STRETCH, np.repeat(first + n, pieces))
        language, which = (x.ravel() for x in np.meshgrid(np.arange(len(self.languages)), np.arange(len(start)), indexing="ij"))
        todo = np.arange(len(which))
        while len(todo):
            changed = []
            lang, at, stop = language[todo], start[which[todo]], end[which[todo]]
            state = trace[lang, at - 1] >> 1
            while len(todo):
                step = self.table.take(state + symbol.take(at))
                same = step >> 1 == trace[lang, at] >> 1
                trace[lang, at] = step
                state = step >> 1
                at = at + 1
                over = at == stop
                changed.append(todo[~same & over])
                go = ~same & ~over
                todo, lang, at, stop, state = todo[go], lang[go], at[go], stop[go], state[go]
            follow = np.concatenate(changed) + 1  # the stretch after it, if of the same text
            follow = follow[follow < len(which)]
            todo = np.sort(follow[nth[which[follow]] > 1])

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, the score (by how much of the second best language's bits the best needs fewer) and the bits a letter of the best."""
        languages, scores, costs = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        group: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            group.append(k)
            held += len(text or b"")
            if held >= BLOCK or k == len(texts) - 1:
                self._predict(group, [(texts[i] or b"").decode("utf-8", "replace") for i in group], languages, scores, costs)
                group, held = [], 0
        return languages, scores, costs

    def _predict(self, group: list[int], texts: list[str], languages: list[str], scores: np.ndarray, costs: np.ndarray) -> None:
        if not self.languages:
            return
        counts, n = self.phrases(texts)
        bits = counts * self.log_size[:, None] / np.maximum(n, 1)[None, :]
        order = np.sort(bits, axis=0)
        best = bits.argmin(axis=0)
        for i, k in enumerate(group):
            if n[i]:
                languages[k] = self.languages[best[i]]
                scores[k] = 1.0 if len(bits) == 1 else 1 - order[0, i] / order[1, i]
                costs[k] = (counts[best[i], i] - 1) * self.log_size[best[i]] / max(1, sum(map(str.isalpha, texts[i])))

    def limits(self, others: dict[str, str]) -> dict[str, float]:
        """Bits a letter beyond which a text is in no learned language: halfway from what other text of the language costs to a phrase a letter."""
        out = {}
        for k, language in enumerate(self.languages):
            text = others.get(language, "")
            counts, n = self.phrases([text])
            own = counts[k, 0] * self.log_size[k] / max(1, sum(map(str.isalpha, text))) if n[0] else 0.0
            out[language] = (own + self.log_size[k]) / 2
        return out


@lru_cache(maxsize=1)
def _letters(alphabet: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point: the gap for all that is no letter, the same for both cases; and the other letters with their spelling."""
    known = {c: i + 2 for i, c in enumerate(alphabet)}
    out, others = np.zeros(0x110000, np.uint8), {}
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = known.get(low, ESCAPE)
            if out[i] == ESCAPE:
                others[i] = ord(low[0])
    digits = {x: [2 + (k // LETTERS**d) % LETTERS for d in range(DIGITS)] for k, x in enumerate(sorted(set(others.values())))}  # fewer than LETTERS ** DIGITS
    return out, np.array([[i, *digits[x]] for i, x in others.items()], np.int64)


_PARSERS: dict[tuple, CrossParser] = {}


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """The worker's parser; one for other samples goes before the next is built."""
    if samples not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[samples] = CrossParser(dict(samples))
    return _PARSERS[samples]


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from learning, by the checksum of its id; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", skip: int = 0) -> tuple[tuple[str, str], ...]:
    """(language, sample of its text): what the automata are built from; with ``skip``, from the rows after so many."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    first = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), (F.octet_length(text_col) > SAMPLE_BYTES).alias("_long"))
    order = Window.partitionBy("_lang").orderBy("_long", F.xxhash64("_id"), "_id")  # few rows a language leave each task
    picked = first.withColumn("_nth", F.row_number().over(order)).where((F.col("_nth") > skip) & (F.col("_nth") <= skip + SAMPLE_ROWS)).select("_id", "_lang", "_nth").distinct()
    text = F.substring(text_col, 1, 8 * SAMPLE_BYTES).alias("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), text).join(F.broadcast(picked), ["_id", "_lang"]).select("_lang", "_nth", "_text").collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], r["_nth"], r["_text"] or "")):
        parts.setdefault(r["_lang"], []).append(r["_text"] or "")
    return tuple((k, " ".join(v)) for k, v in sorted(parts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""

    def run(p: CrossParser, texts: list) -> list:
        return list(p.predict(texts)[:2])

    return map_texts(docs, id_col, text_col, run, "lang_pred string, score double", worker=lambda: parser(samples))


def learn_limits(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> dict[str, float]:
    """CrossParser.limits() from the rows after those of the samples, in a task: the automata are too large for the driver."""
    others = dict(learn(docs, skip=SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found = parser(samples).limits(others)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["lang", "most"])

    return {r["lang"]: r["most"] for r in docs.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "lang string, most double").collect()}


def keep(docs: DataFrame, samples: tuple[tuple[str, str], ...], limits: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows whose whole text is in one of the learned languages: determined, at no more bits a letter than the language's limit."""

    def run(p: CrossParser, texts: list) -> list:
        languages, _, costs = p.predict(texts)
        return [k != UNDETERMINED and c <= limits[k] for k, c in zip(languages, costs.tolist(), strict=True)]

    return filter_texts(docs, text_col, run, worker=lambda: parser(samples))
