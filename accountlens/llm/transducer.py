"""A byte-pair tokenizer as a deterministic transducer that counts tokens.

The machine reads the bytes of a word; a word's last byte is a symbol of its own.
A prefix of a word has one encoding, and its last token follows from the last
tokens of shorter prefixes: it is the one that ends there and stands next to the
last token before it as the merges leave the two. No token reaches back further than
the longest end of the prefix that begins some token. A state is therefore that
end, with the last token and the number of tokens, counted from the present one, at
each of its places; there are finitely many. A transition is annotated with the
tokens that it emits: the change in their number, which is below 1 where tokens
join. A word's last symbol leads back to the start, so texts are read as one word
after the other.

Transitions are compiled as they occur, and stay; beyond ``STATES`` states the
machine starts anew, which changes no result. Words run side by side, and so do the
stretches of a long word.
"""

from __future__ import annotations

import numpy as np

#: States held at most, bytes from which on a word runs by itself, and then bytes of it that are read together and in a stretch.
STATES, LONG_WORD, PART, STRETCH = 200_000, 96, 1 << 18, 128
LAST = 256  # what the last symbol of a word has on top of its byte


class Machine:
    """vocabulary: tokens as strings of symbols; ranks: two tokens that merge -> rank."""

    def __init__(self, vocabulary: set[str], ranks: dict[tuple[str, str], int]):
        self.vocabulary, self.ranks = vocabulary, ranks
        self.begins = {t[:i] for t in vocabulary for i in range(len(t))}
        self._clear()

    def _clear(self) -> None:
        self.states = [("", ("",), (0,))]
        self.number = {self.states[0]: 0}
        self.beside: dict[tuple[str, str], bool] = {}
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.known: dict[int, tuple[int, int]] = {}

    def encode(self, symbols: str) -> list[str]:
        """Tokens of a short string: the merge of the lowest rank first, of equal ones the leftmost."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))  # noqa: B905
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, before: str, token: str) -> bool:
        """Whether two tokens side by side stay as they are; nothing before: whether the token is its own encoding."""
        found = self.beside.get((before, token))
        if found is None:
            found = self.beside[before, token] = self.encode(before + token) == ([before, token] if before else [token])
        return found

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and emitted tokens."""
        end, lasts, counts = self.states[state]
        end += chr(symbol)
        at = next(i for i in range(len(end)) if end[i:] in self.vocabulary and self._stay("", end[i:]) and self._stay(lasts[i], end[i:]))
        emitted = counts[at] + 1
        if symbol >= LAST:
            return 0, emitted
        keep = next(i for i in range(len(end) + 1) if end[i:] in self.begins)
        new = end[keep:], (*lasts, end[at:])[keep:], tuple(c - emitted for c in (*counts, emitted)[keep:])
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], emitted

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        todo = np.flatnonzero((have := self.keys.take(slot)) != keys)
        todo = todo[have[todo] != -1]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[todo]]
            todo = todo[(have != keys[todo]) & (have != -1)]
        return slot

    def _compile(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            self.known[key] = self._step(key >> 9, key & 511)
        if 2 * len(self.known) > 1 << self.bits:
            while 4 * len(self.known) > 1 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            keys = np.fromiter(self.known, np.int64, len(self.known))
        todo = keys
        while len(todo):  # of those that want one free slot, one gets it; the rest try again
            slot = self._find(todo)
            self.keys[slot] = todo
            todo = todo[self.keys[slot] != todo]
        slot = self._find(keys)
        self.to[slot], self.emits[slot] = np.array([self.known[k] for k in keys.tolist()], np.int32).reshape(-1, 2).T

    def _steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted tokens of (state, symbol) keys, compiled where they are new."""
        slot = self._find(keys)
        missing = self.keys.take(slot) != keys
        if missing.any():
            self._compile(np.unique(keys[missing]))
            slot = self._find(keys)
        return self.to.take(slot), self.emits.take(slot)

    def _run(self, symbols: np.ndarray) -> int:
        """Tokens of one long word."""
        state = total = 0
        for a in range(0, len(symbols), PART):
            if a and len(self.states) > STATES:  # go on from a new copy
                held = self.states[state]
                self._clear()
                state = self.number.setdefault(held, 1)
                self.states.append(held)
            emitted, state = self._part(symbols[a : a + PART], state)
            total += emitted
        return total

    def _part(self, symbols: np.ndarray, state: int) -> tuple[int, int]:
        """(emitted, state after) of a part of a word that is read from a state.

        Stretches of the part run side by side, each as if a word began there; then each
        is read again from the state before it until it is in the state that it was in,
        as long as the end of any changes. So the states are those of one run.
        """
        n = len(symbols)
        starts = np.arange(0, n, STRETCH)
        lens = np.minimum(STRETCH, n - starts)
        states, emits = np.zeros(n, np.int64), np.zeros(n, np.int64)
        now = np.zeros(len(starts), np.int64)
        now[0] = state
        for j in range(int(lens.max())):
            k = len(starts) - (lens[-1] <= j)  # only the last one is shorter
            now[:k], emits[starts[:k] + j] = self._steps(now[:k] << 9 | symbols[starts[:k] + j])
            states[starts[:k] + j] = now[:k]
        todo = np.arange(1, len(starts))
        while len(todo):
            at, stop, now = starts[todo], starts[todo] + lens[todo], states[starts[todo] - 1]
            changed = []
            while len(todo):
                now, emitted = self._steps(now << 9 | symbols[at])
                same = states[at] == now
                states[at], emits[at] = now, emitted
                at = at + 1
                over = at == stop
                changed.append(todo[~same & over])
                go = ~same & ~over
                todo, at, stop, now = todo[go], at[go], stop[go], now[go]
            follow = np.concatenate(changed) + 1
            todo = np.sort(follow[follow < len(starts)])
        return int(emits.sum()), int(states[-1])

    def counts(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each word (at least a byte) of the data. Equal words run once."""
        if len(self.states) > STATES:
            self._clear()
        symbols = np.frombuffer(data, np.uint8).astype(np.int64)
        symbols[starts + lens - 1] += LAST
        out = np.zeros(len(starts), np.int64)
        first, which = different(data, starts, lens)
        order = first[np.argsort(-lens[first], kind="stable")]
        at, n = starts[order], lens[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left")
        for j, k in enumerate(active.tolist()):
            state[:k], emitted = self._steps(state[:k] << 9 | symbols.take(at[:k] + j))
            total[:k] += emitted
        out[order] = total
        for i in np.flatnonzero(lens > LONG_WORD).tolist():
            out[i] = self._run(symbols[starts[i] : starts[i] + lens[i]])
        return out.take(which)


def different(data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most LONG_WORD bytes, of equal ones of at most 15 bytes one, and for each word its equal."""
    which = np.arange(len(starts))
    padded = np.frombuffer(data + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 8,), (1,))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    short = np.flatnonzero(lens <= 15)
    s, n = starts[short], lens[short]
    low = words[s] & masks.take(np.minimum(n, 8))
    high = (n.astype(np.uint64) << np.uint64(56)) | (words[np.minimum(s + 8, len(data))] & masks.take(np.maximum(n - 8, 0)))
    order = np.lexsort((low, high))
    lead = np.ones(len(order), bool)
    lead[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    first = short[order[lead]]
    which[short[order]] = first[np.cumsum(lead) - 1]
    return np.concatenate([first, np.flatnonzero((lens > 15) & (lens <= LONG_WORD))]), which


def compiled(model: dict, shown: list[str]) -> Machine:
    """The machine of a JSON file's model. shown: the character that stands for each byte."""
    suffix = model.get("end_of_word_suffix") or ""
    symbol = {c: chr(i) for i, c in enumerate(shown)}

    def read(word: str) -> str | None:
        last = bool(suffix) and word.endswith(suffix)
        body = word[: -len(suffix)] if last else word
        if not body or any(c not in symbol for c in body):
            return None
        out = "".join(symbol[c] for c in body)
        return out[:-1] + chr(ord(out[-1]) + LAST) if last else out

    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks: dict[tuple[str, str], int] = {}
    for i, (a, b) in enumerate(pairs):
        ranks[read(a), read(b)] = i
    return Machine({x for x in map(read, model["vocab"]) if x}, ranks)
