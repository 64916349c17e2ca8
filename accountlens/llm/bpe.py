"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised: code points become class arrays, and a scan of
associative transition functions (:mod:`.scan`) locates the boundaries, without a
regular expression. The slices feed a cache of merged pieces; pieces that are not
in it are merged together, as arrays. Offsets of ids and of token bytes are kept,
so that ids are decoded by lookup.

Defined cases: null and empty texts give no ids; texts of any length are encoded
whole, in blocks cut where a boundary is certain; equal texts give equal ids; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .scan import TransitionScan

SEPARATOR = 0xFF  # no byte of UTF-8: it separates the texts of a block
BLOCK_BYTES = 1 << 19
#: Distinct pieces kept in a worker's cache; it starts anew beyond them, which changes no result.
CACHE_PIECES = 500_000
#: Pieces of more bytes are merged one by one with a heap, in n log n.
LONG_PIECE = 256
NONE = np.int32(2**31 - 1)

# The white space of the Unicode standard.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


# Symbols of the scan: classes, some with what lies ahead. LEAD and INSIDE mark bytes of longer characters.
S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_LAST_BLANK, S_LAST_SPACE, S_SHORT, S_LONG, S_END, LEAD, INSIDE = range(11)
# States: what the token so far is. FRESH: the next character starts a token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(maxsize=1)
def _boundary_automaton() -> tuple[TransitionScan, np.ndarray]:
    """The scan, and whether a token starts, by symbol and state."""
    delta, starts = np.zeros((9, 8), np.int64), np.ones((9, 8), bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    for state in range(8):
        for symbol, inside in runs.items():
            delta[symbol, state] = inside
            starts[symbol, state] = state not in (inside, AFTER_BLANK)
        delta[S_INNER, state], starts[S_INNER, state] = IN_SPACE, state != IN_SPACE
        delta[S_LAST_BLANK, state] = AFTER_BLANK
        delta[S_LAST_SPACE, state] = FRESH
        for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
            joined = state in (IN_OTHERS, AFTER_BLANK)
            delta[symbol, state], starts[symbol, state] = (IN_OTHERS, False) if joined else (left, True)
    for state, then in ((ONE_LEFT, FRESH), (TWO_LEFT, ONE_LEFT)):
        delta[:, state], starts[:, state] = then, False
    delta[S_END, :], starts[S_END, :] = FRESH, True
    return TransitionScan(delta), starts.ravel()


@lru_cache(maxsize=1)
def codepoint_symbols() -> np.ndarray:
    """Letter, number, other or white space, for each code point."""
    out = np.full(0x110000, S_OTHER, np.uint8)
    kind = {"L": S_LETTER, "N": S_NUMBER}
    for i in range(0x110000):
        k = kind.get(unicodedata.category(chr(i))[0])
        if k is not None:
            out[i] = k
    out[WHITE_SPACE] = S_INNER
    return out


# The pattern of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from here on are no letters or numbers in any version of Unicode so far.
PROBED = 0x40000


def _probe_text() -> tuple[str, np.ndarray]:
    """Each code point after a letter and after a sign, and which these are."""
    cps = np.array([i for i in range(0x80, PROBED) if not 0xD800 <= i < 0xE000 and i not in WHITE_SPACE])
    return "".join(f"a{chr(i)}!{chr(i)}\n" for i in cps.tolist()), cps


def _classes(cps: np.ndarray, breaks: np.ndarray) -> bytes:
    """Classes as a worker gets them. breaks: whether a piece starts at each character of the probe text."""
    out = codepoint_symbols().copy()
    letter, other = ~breaks[1::5], ~breaks[3::5]
    out[cps] = np.where(letter, S_LETTER, np.where(other, S_OTHER, S_NUMBER))
    return zlib.compress(out.tobytes())


@lru_cache(maxsize=2)
def ranks_classes(pattern: str = PATTERN) -> bytes:
    """The classes of code points that tiktoken splits by: its tables are of another version of Unicode than Python's."""
    import tiktoken

    text, cps = _probe_text()
    pairs = [bytes([a, lead]) for a in b"a!" for lead in range(0xC2, 0xF5)]
    ranks = {x: i for i, x in enumerate([*(bytes([i]) for i in range(256)), *pairs])}  # a piece shows as a pair across its characters
    ids = np.array(tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))
    starts = np.zeros(len(text.encode()) + 1, bool)
    starts[np.concatenate([[0], np.cumsum(np.where(ids < 256, 1, 2))])] = True
    first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    return _classes(cps, starts[:-1][first])


@lru_cache(maxsize=2)
def json_classes(path: str) -> bytes:
    """The same of the tokenizers library and the file's pre-tokenizer."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    text, cps = _probe_text()
    breaks = np.zeros(len(text) + 1, bool)
    for a in range(0, len(text), 50_000):  # whole groups of five characters
        breaks[[a + x[1][0] for x in split.pre_tokenize_str(text[a : a + 50_000])]] = True
    return _classes(cps, breaks[:-1])


def class_table(classes: bytes | None) -> np.ndarray:
    return codepoint_symbols() if classes is None else np.frombuffer(zlib.decompress(classes), np.uint8)


@lru_cache(maxsize=1)
def _byte_symbols() -> bytes:
    table = codepoint_symbols()[:256].copy()
    table[0x80:0xC0], table[0xC0:], table[SEPARATOR] = INSIDE, LEAD, S_END
    return table.tobytes()


def _codepoints_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters of more than one byte that start at the given places."""
    raw = np.append(raw, np.zeros(3, np.uint8))
    a, b, c, d = (raw[at + i].astype(np.int64) for i in range(4))
    two, three = ((a & 0x1F) << 6) | (b & 0x3F), ((a & 0x0F) << 12) | ((b & 0x3F) << 6) | (c & 0x3F)
    four = ((a & 0x07) << 18) | ((b & 0x3F) << 12) | ((c & 0x3F) << 6) | (d & 0x3F)
    return np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)) % 0x110000


def characters(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Symbol and first byte of each character, and where they start (None: everywhere)."""
    raw = np.frombuffer(data, np.uint8)
    symbol = np.frombuffer(bytearray(data.translate(_byte_symbols())), np.uint8)
    if data.isascii():
        return symbol, raw, None
    at = np.flatnonzero(symbol != INSIDE)
    symbol = symbol[at]
    longer = np.flatnonzero(symbol == LEAD)
    symbol[longer] = table[_codepoints_at(raw, at[longer])]
    return symbol, raw[at], at


def mark_contractions(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the quotes that 's 't 'm 'd 're 've 'll may start with; returns where they are."""
    quotes = np.flatnonzero(first == 0x27)
    ahead = np.append(first, np.zeros(2, np.uint8))
    a, b = ahead[quotes + 1], ahead[quotes + 2]
    short = quotes[(a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))]
    long = quotes[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
    symbol[short], symbol[long] = S_SHORT, S_LONG
    return np.concatenate([short, long])


def changes(symbol: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Places that the scan has to read: a symbol after itself changes no state, but for the letters of contractions."""
    keep = np.ones(len(symbol), bool)
    np.not_equal(symbol[1:], symbol[:-1], out=keep[1:])
    keep |= symbol == S_END
    for i in (1, 2, 3):
        keep[np.minimum(marked + i, len(symbol) - 1)] = True
    return np.flatnonzero(keep)


def token_starts(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where tokens start, and which of these are of separators. The texts stand between separators."""
    scan, starts = _boundary_automaton()
    symbol, first, at = characters(data, table)
    space = symbol == S_INNER
    solid = ~space & (symbol != S_END)
    last = np.flatnonzero(space[:-1] & solid[1:])
    marked = mark_contractions(symbol, first)
    symbol[last] = np.where(first[last] == 0x20, S_LAST_BLANK, S_LAST_SPACE)
    some = changes(symbol, marked)
    symbol = symbol[some]
    which = np.flatnonzero(starts.take(symbol.astype(np.intp) * 8 + scan.states_before(symbol)))
    begin = some[which]
    return begin if at is None else at[begin], symbol[which] == S_END


# Bytes before which a text may be cut, if an ASCII character that is no space comes before.
_CUT = re.compile(rb"[\x21-\x7e](?=[\x09-\x0d\x20])")


def blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Parts of a long text, each but the first starting with a space after a non-space: a boundary whatever stands around."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class PairTable:
    """Merges in an open-addressed table: (left, right) -> rank, merged id."""

    def __init__(self, left, right, rank, merged, n_ids: int):
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.merged = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.merged[rank] = merged
        keys, todo = (left << 32) | right, np.arange(len(left))
        slot = self._slot(keys)
        while len(todo):  # of those that want one free slot, one gets it; the rest move on
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        # Whether all merges with a token come after the one that makes it: then all equal pairs merge at once.
        least = np.full(n_ids, NONE, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.ordered = np.zeros(len(self.merged), bool)
        self.ordered[rank] = least[merged] > rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        have = self.keys.take(slot)
        out = np.where(have == keys, self.ranks.take(slot), NONE)
        todo = np.flatnonzero((have != keys) & (have != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[todo]]
            hit = have == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (have != -1)]
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """One piece, with a heap of (rank, place) over a linked list."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            if pair not in memo:
                memo[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if memo[pair] != NONE:
                heapq.heappush(heap, (memo[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many pieces side by side. ids of all pieces, length of each (at least 1); returns the same."""
        n = len(lengths)
        out_len = lengths.astype(np.int64).copy()
        place = np.arange(n)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ids = ids.astype(np.int32)
        ends = np.cumsum(lengths)
        rank = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends - 1] = NONE
        lengths = out_len.copy()
        while len(lengths):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                each = np.repeat(over, lengths)
                done.append((place[over], ids[each]))
                out_len[place[over]] = lengths[over]
                keep = ~each
                ids, rank, lengths, place, least = ids[keep], rank[keep], lengths[~over], place[~over], least[~over]
                if not len(lengths):
                    break
            which = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero(rank == least[which])
            r = rank[at]
            piece = which[at]
            # Of neighbours that overlap the first, third, ... merge; of a rank that is not ordered only the first of its piece.
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - head) % 2 == 0
            first = np.ones(len(at), bool)
            first[1:] = piece[1:] != piece[:-1]
            take &= first | self.ordered[r]
            at, r, piece = at[take], r[take], piece[take]
            ids[at] = self.merged[r]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(piece, minlength=len(lengths))
            moved = at - np.arange(len(at))
            ids, rank = ids[keep], rank[keep]
            ends = np.cumsum(lengths) - 1
            is_end = np.zeros(len(ids), bool)
            is_end[ends] = True
            near = np.concatenate([moved, moved[moved > 0] - 1])
            near = near[~is_end[near]]
            rank[near] = self.rank(ids[near], ids[near + 1])
            rank[ends] = NONE
        total = np.cumsum(out_len)
        out = np.empty(int(total[-1]) if n else 0, np.int32)
        for where, values in done:
            lens = out_len[where]
            begin = np.repeat(total[where] - lens - (np.cumsum(lens) - lens), lens)
            out[begin + np.arange(len(values))] = values
        return out, out_len


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all slices, one slice after the other."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    shift += np.arange(len(shift))
    return shift


class PieceEncoder:
    """Ids of byte pieces, by cached pair merging.

    Pieces of at most 15 bytes are found by two words that hold their bytes and
    length, in an open-addressed table; longer ones in a dict.
    """

    MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1] * 9, np.uint64)

    def __init__(self, pairs: PairTable, byte_ids: np.ndarray):
        self.pairs, self.byte_ids = pairs, byte_ids
        self._clear()

    def _clear(self) -> None:
        self.bits = 14
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)
        self.longer: dict[bytes, int] = {}
        self.flat, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.known = 0

    def _add(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        ids = self.byte_ids.take(raw.take(ragged(starts, lens)))
        if (lens > LONG_PIECE).any():
            cut = np.split(ids, np.cumsum(lens)[:-1])
            short = np.flatnonzero(lens <= LONG_PIECE)
            merged: list = [None] * len(cut)
            if len(short):
                some, n = self.pairs.merge(np.concatenate([cut[i] for i in short]), lens[short])
                for i, x in zip(short, np.split(some, np.cumsum(n)[:-1]), strict=True):
                    merged[i] = x
            for i in np.flatnonzero(lens > LONG_PIECE):
                merged[i] = np.array(self.pairs.merge_long(cut[i].tolist()), np.int32)
            ids, lens = np.concatenate(merged), np.array([len(x) for x in merged], np.int64)
        else:
            ids, lens = self.pairs.merge(ids, lens)
        self._keep(ids, lens)

    def _keep(self, ids: np.ndarray, lens: np.ndarray) -> None:
        """The ids of new pieces, one after the other."""
        first, n = int(self.offsets[self.known]), len(ids)
        while first + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(lens) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[first : first + n] = ids
        self.offsets[self.known + 1 : self.known + 1 + len(lens)] = first + np.cumsum(lens)
        self.known += len(lens)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.intp)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and which are free: those keys are not there."""
        slot = self._slot(low, high)
        have = self.high.take(slot)
        free = have == 0
        todo = np.flatnonzero(~free & ((have != high) | (self.low.take(slot) != low)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.high[slot[todo]]
            free[todo] = have == 0
            todo = todo[(have != 0) & ((have != high[todo]) | (self.low[slot[todo]] != low[todo]))]
        return slot, free

    def _put(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not there."""
        todo, slot = np.arange(len(low)), self._slot(low, high)
        while len(todo):
            free = todo[self.high[slot[todo]] == 0]
            self.high[slot[free]] = high[free]
            self.low[slot[free]] = low[free]
            won = (self.high[slot[todo]] == high[todo]) & (self.low[slot[todo]] == low[todo])
            self.numbers[slot[todo[won]]] = numbers[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _grow(self, wanted: int) -> None:
        while wanted * 5 > (3 << self.bits):
            used = np.flatnonzero(self.high)
            old = self.low[used], self.high[used], self.numbers[used]
            self.bits += 1
            self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
            self.numbers = np.zeros(1 << self.bits, np.int32)
            self._put(*old)

    def number(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Number of each slice of the data (at least a byte), after all new pieces have been merged."""
        if self.known > CACHE_PIECES:
            self._clear()
        out = np.empty(len(starts), np.int64)
        padded = np.frombuffer(data + bytes(16), np.uint8)
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 8,), (1,))
        short = np.flatnonzero(lens <= 15)
        s, n = starts[short], lens[short]
        low = words[s] & self.MASKS.take(n)
        high = n.astype(np.uint64) << np.uint64(56)
        two = np.flatnonzero(n > 8)
        high[two] |= words[s[two] + 8] & self.MASKS.take(n[two] - 8)
        slot, free = self._find(low, high)
        out[short] = self.numbers.take(slot)
        new = np.flatnonzero(free)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            lead = np.ones(len(order), bool)
            lead[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            out[short[order]] = self.known + np.cumsum(lead) - 1
            one = order[lead]
            self._grow(self.known + len(one))
            self._put(low[one], high[one], np.arange(self.known, self.known + len(one), dtype=np.int32))
            self._add(padded, s[one], n[one])
        rest = np.flatnonzero(lens > 15)
        if len(rest):
            found, fresh, known = [], [], self.longer
            for k, a, b in zip(rest.tolist(), starts[rest].tolist(), (starts + lens)[rest].tolist(), strict=True):
                piece = data[a:b]
                i = known.get(piece, -1)
                if i < 0:
                    i = known[piece] = self.known + len(fresh)
                    fresh.append(k)
                found.append(i)
            out[rest] = found
            if fresh:
                self._add(padded, starts[fresh], lens[fresh])
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return self.offsets.take(numbers + 1) - self.offsets.take(numbers)

    def ids(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.flat.take(ragged(self.offsets.take(numbers), counts))


class LibraryPieces(PieceEncoder):
    """Ids of byte pieces by the model of the tokenizers library, each different piece once."""

    def __init__(self, model):
        self.model = model
        self.shown = "".join(byte_characters())
        self._clear()

    def _add(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        text = raw[ragged(starts, lens)].tobytes().decode("latin-1").translate(dict(enumerate(self.shown)))
        ends = np.cumsum(lens).tolist()
        found = [[t.id for t in self.model.tokenize(text[a:b])] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self._keep(np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))


def gathered(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (number of the text, part of it) of about a block together; texts of more than two blocks come in parts."""
    group: list[tuple[int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        for part in blocks(text, size) if len(text) > 2 * size else (text,):
            group.append((k, part))
            held += len(part)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def split_specials(text: bytes, specials) -> list[bytes]:
    """The text between special strings and the strings themselves, in turn."""
    parts, at = [], 0
    while True:
        found = min(((i, -len(s), s) for s in specials if (i := text.find(s, at)) >= 0), default=None)
        if found is None:
            return [*parts, text[at:]]
        parts += [text[at : found[0]], found[2]]
        at = found[0] - found[1]


class ByteLevelBPE:
    """Encodes lists of texts into ids, and decodes ids."""

    def __init__(self, tokens: list[bytes], encoder: PieceEncoder, specials: dict[bytes, int] | None = None, classes: bytes | None = None):
        self.tokens, self.encoder, self.specials, self.classes = tokens, encoder, specials or {}, class_table(classes)

    @classmethod
    def from_ranks(cls, path: str, classes: bytes | None = None) -> ByteLevelBPE:
        """A rank file: two tokens merge if their bytes together are a token, lowest rank first."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            tokens[r] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        return cls(tokens, PieceEncoder(PairTable(left, right, rank, rank, len(tokens)), byte_ids), classes=classes)

    @classmethod
    def from_json(cls, path: str, classes: bytes | None = None) -> ByteLevelBPE:
        """A file of the tokenizers library, whose model encodes the pieces."""
        from tokenizers import Tokenizer

        spec = read_json(path)
        vocab, shown = spec["model"]["vocab"], byte_characters()
        specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        back = {c: i for i, c in enumerate(shown)}
        tokens = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for word, i in vocab.items():
            tokens[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in specials.items():
            tokens[i] = word
        return cls(tokens, LibraryPieces(Tokenizer.from_file(path).model), specials, classes)

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text (UTF-8), in order."""
        parts: list[bytes] = []
        owners: list[tuple[int, int]] = []  # of each part the text, and the id if it is a special string
        for k, text in enumerate(texts):
            text = text or b""
            if any(s in text for s in self.specials):
                for j, part in enumerate(split_specials(text, self.specials)):
                    parts.append(b"" if j % 2 else part)
                    owners.append((k, self.specials[part] if j % 2 else -1))
            else:
                parts.append(text)
                owners.append((k, -1))
        at, held = 0, []
        for group in gathered(parts):
            for (j, _), ids in zip(group, self._encode_block([x for _, x in group]), strict=True):
                k, special = owners[j]
                while at < k:
                    yield _joined(held)
                    at, held = at + 1, []
                held.append(ids if special < 0 else np.array([special], np.int32))
        while at < len(texts):
            yield _joined(held)
            at, held = at + 1, []

    def _encode_block(self, parts: list[bytes]) -> list[np.ndarray]:
        data = b"\xff".join(parts)
        if not data:
            return [np.zeros(0, np.int32) for _ in parts]
        starts, closing = token_starts(data, self.classes)
        lens = np.diff(np.append(starts, len(data)))
        words = ~closing
        numbers = self.encoder.number(data, starts[words], lens[words])
        counts = self.encoder.counts(numbers)
        ids = self.encoder.ids(numbers, counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = total[np.cumsum(words)[closing]].tolist()
        return [ids[a:b] for a, b in zip([0, *edges], [*edges, len(ids)], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in JSON vocabularies: itself, or the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else free))
        free += b not in own
    return out


@lru_cache(maxsize=2)
def ranks_codec(path: str, classes: bytes | None = None) -> ByteLevelBPE:
    return ByteLevelBPE.from_ranks(path, classes)


@lru_cache(maxsize=2)
def json_codec(path: str, classes: bytes | None = None) -> ByteLevelBPE:
    return ByteLevelBPE.from_json(path, classes)


def encode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    classes = ranks_classes()

    def run(codec: ByteLevelBPE, texts: list) -> list:
        return [[ids.tolist() for ids in codec.encode(texts)]]

    return map_texts(df, id_col, text_col, run, "ids array<int>", worker=lambda: ranks_codec(vocabulary, classes))


def decode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids, null for null; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks_codec(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], ["_key", "text"])

    kept = df.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{ids_col}`").alias("_ids"))
    return kept.mapInArrow(run, f"_key {kept.schema['_key'].dataType.simpleString()}, text string").withColumnRenamed("_key", id_col)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; returns (id, n_tokens, ids_sha256, decoded_sha256)."""
    classes = ranks_classes()

    def run(codec: ByteLevelBPE, texts: list) -> list:
        n, ids_sha, decoded_sha = [], [], []
        for ids in codec.encode(texts):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [n, ids_sha, decoded_sha]

    return map_texts(df, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", worker=lambda: ranks_codec(vocabulary, classes))
