"""Associative transition-function scans of small automata over long arrays.

Every symbol of an automaton is a function from states to states. The functions
of all strings form a finite monoid, so a run over an array is a prefix
composition: blocks are scanned side by side, the blocks' own maps are composed
by the same scan one level up, and each position's state is looked up from its
block's entry state. No position waits for the one before its block.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128


class TransitionScan:
    """Prefix composition of the transition functions of a complete automaton.

    ``delta[symbol][state]`` is the next state. ``states_before`` gives the state
    in which each position's symbol is read, from state 0 at the start.
    """

    def __init__(self, delta: np.ndarray):
        delta = np.asarray(delta)
        self.n_states = delta.shape[1]
        rows = [tuple(int(x) for x in row) for row in delta]
        identity = tuple(range(self.n_states))
        found, order = {identity: 0}, [identity]
        for f in order:  # grows while it is read: the closure under the symbols
            for g in rows:
                fg = tuple(g[s] for s in f)
                if fg not in found:
                    found[fg] = len(order)
                    order.append(fg)
        size = len(order)
        maps = np.array(order, dtype=np.intp)
        self.of_symbol = np.array([found[r] for r in rows], dtype=np.intp)
        self.size = size
        self.maps = maps.astype(np.uint8).ravel()
        places = self.n_states ** np.arange(self.n_states)
        codes = maps @ places
        rank = np.argsort(codes)
        both = maps[:, maps] @ places  # [g, f]: first f, then g
        self.compose = np.ascontiguousarray(rank[np.searchsorted(codes, both, sorter=rank)].T).ravel().astype(np.intp)

    def _prefix(self, elements: np.ndarray) -> tuple[np.ndarray, int]:
        """Map of all positions before each one, and of all together."""
        n = len(elements)
        if n <= BLOCK:
            out, acc, compose, size = np.empty(n, np.intp), 0, self.compose, self.size
            for i, e in enumerate(elements.tolist()):
                out[i] = acc
                acc = compose[acc * size + e]
            return out, int(acc)
        lanes = -(-n // BLOCK)
        padded = np.zeros(lanes * BLOCK, np.intp)
        padded[:n] = elements
        columns = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
        within = np.empty((BLOCK, lanes), np.intp)
        acc = np.zeros(lanes, np.intp)
        for j in range(BLOCK):
            within[j] = acc
            acc = self.compose.take(acc * self.size + columns[j])
        before, total = self._prefix(acc)
        within = self.compose.take(before[None, :] * self.size + within)
        return np.ascontiguousarray(within.T).ravel()[:n], total

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        if n == 0:
            return np.zeros(0, np.uint8)
        lanes = -(-n // BLOCK)
        padded = np.zeros(lanes * BLOCK, np.intp)
        padded[:n] = self.of_symbol.take(symbols)
        columns = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
        within = np.empty((BLOCK, lanes), np.intp)
        acc = np.zeros(lanes, np.intp)
        for j in range(BLOCK):
            within[j] = acc
            acc = self.compose.take(acc * self.size + columns[j])
        entry = self.maps.take(self._prefix(acc)[0] * self.n_states).astype(np.intp)  # from state 0
        states = self.maps.take(within * self.n_states + entry[None, :])
        return np.ascontiguousarray(states.T).ravel()[:n]
