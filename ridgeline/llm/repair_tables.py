"""Cheapest edits of a sequence of turns by tables of whole blocks.

A repaired conversation's role initials read ``(s?(ua)+)?``, which four states
tell: nothing yet, after s, after u, after a.  What a turn means to the edits is
one of nine symbols.  The cost to go from each state to the end is a vector;
without its least entry it is one of a few dozen, so that a block of symbols is
a table from the vector behind it to the vector before it and the increment
between the two.  Sequences are looked up block by block from their end; for
the edits a block is expanded backward, from the vector behind it to one behind
each symbol, and then walked forward: with costs to go known, the least letter
that is still cheapest is always right, so ties need no second look.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

#: After nothing, s, u, a: the next state and role of an inserted or changed turn.
FORCED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: The next state of a kept turn by its initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
STATES = 4
#: Symbol 0 is a turn that must go; 1 + 2 * (place of its initial) + (1 if truncated) any other.
INITIALS = "sua"
SYMBOLS = 9


@dataclass(frozen=True)
class Costs:
    """Prices of edits; keeping is free.  ``truncated``: of each truncated turn
    that is not deleted.  ``block``: symbols of a block."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    block: int = 4


class Tables:
    """Transitions of symbols and blocks between vectors."""

    def __init__(self, costs: Costs):
        self.costs = costs
        vectors = [self._normal(self._with_inserts([0 if q in ENDS else 10**6 for q in range(STATES)]))[1]]
        self.vectors, moves = vectors, []
        for v in vectors:  # grows as new vectors are found
            row = []
            for symbol in range(SYMBOLS):
                least, new = self._normal(self._before(symbol, v))
                if new not in vectors:
                    vectors.append(new)
                row.append((vectors.index(new), least, [self._walk(symbol, v, q) for q in range(STATES)]))
            moves.append(row)
        grid = [[moves[v][s] for v in range(len(vectors))] for s in range(SYMBOLS)]
        self.next = np.array([[m[0] for m in row] for row in grid], dtype=np.int16)
        self.gain = np.array([[m[1] for m in row] for row in grid], dtype=np.int64)
        self.exit = np.array([[[w[1] for w in m[2]] for m in row] for row in grid], dtype=np.int8)
        self.edits = [[[w[0] for w in m[2]] for m in row] for row in grid]
        self.block_next, self.block_gain, self.block_exit = self.next, self.gain, self.exit
        for _ in range(costs.block - 1):
            # One more symbol before the blocks so far.
            self.block_next, self.block_gain, self.block_exit = self._prefixed()
        self.tail = self._trailing()

    @staticmethod
    def _normal(vector: list[int]) -> tuple[int, tuple[int, ...]]:
        return min(vector), tuple(x - min(vector) for x in vector)

    def _with_inserts(self, vector: list[int]) -> list[int]:
        out = list(vector)
        for _ in range(STATES):
            out = [min(vector[q], self.costs.insert + out[FORCED[q][0]]) for q in range(STATES)]
        return out

    def _consuming(self, symbol: int, after: tuple[int, ...], q: int) -> list[tuple[str, int, int, str | None]]:
        """(letter, cost to go, state, new role) of the edits that use up a turn."""
        c = self.costs
        out: list[tuple[str, int, int, str | None]] = [("D", c.delete + after[q], q, None)]
        if symbol:
            place, cut = divmod(symbol - 1, 2)
            to = KEPT.get((q, INITIALS[place])) if place < len(INITIALS) else None
            if to is not None:
                out.append(("K", c.truncated * cut + after[to], to, None))
            out.append(("R", c.rerole + c.truncated * cut + after[FORCED[q][0]], *FORCED[q]))
        return out

    def _before(self, symbol: int, after: tuple[int, ...]) -> list[int]:
        return self._with_inserts([min(m[1] for m in self._consuming(symbol, after, q)) for q in range(STATES)])

    def _walk(self, symbol: int, after: tuple[int, ...], q: int) -> tuple[list[tuple[str, str | None]], int]:
        """The least letters among the cheapest for one turn, with the roles
        that they set, and the state behind it."""
        before, out = self._before(symbol, after), []
        while True:
            insert = ("I", self.costs.insert + before[FORCED[q][0]], *FORCED[q])
            letter, _, q, role = min(m for m in [*self._consuming(symbol, after, q), insert] if m[1] == before[q])
            out.append((letter, role))
            if letter != "I":
                return out, q

    def _trailing(self) -> list[list[tuple[str, str | None]]]:
        """Inserts that end a conversation from each state."""
        found = []
        for q in range(STATES):
            own: list[tuple[str, str | None]] = []
            while q not in ENDS:
                q, role = FORCED[q]
                own.append(("I", role))
            found.append(own)
        return found

    def _prefixed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner, rows = self.block_next, np.arange(len(self.block_next))[None, :, None]
        symbol, ids = np.arange(SYMBOLS)[:, None, None], np.arange(inner.shape[1])[None, None, :]
        following = self.next[symbol, inner[None]]
        gain = self.block_gain[None] + self.gain[symbol, inner[None]]
        state = self.exit[symbol, inner[None]]
        leave = self.block_exit[rows[..., None], ids[..., None], state]
        return tuple(x.reshape(-1, *x.shape[2:]) for x in (following, gain, leave))

    def _codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the whole blocks from the start, and the symbols left over."""
        size = self.costs.block
        whole = len(symbols) // size * size
        powers = SYMBOLS ** np.arange(size - 1, -1, -1)
        return symbols[:whole].reshape(-1, size).astype(np.int64) @ powers, symbols[whole:]

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector behind the symbols: the vector before them, the
        increment, and the state behind them for each state before them."""
        ids = np.arange(len(self.vectors))
        gain, leave = np.zeros(len(ids), dtype=np.int64), np.tile(np.arange(STATES, dtype=np.int8), (len(ids), 1))
        codes, rest = self._codes(symbols)
        for tables, keys in (((self.next, self.gain, self.exit), rest), ((self.block_next, self.block_gain, self.block_exit), codes)):
            for key in keys[::-1]:
                leave = np.take_along_axis(leave, tables[2][key, ids].astype(np.int64), axis=1)
                gain, ids = gain + tables[1][key, ids], tables[0][key, ids]
        return ids, gain, leave

    def trace(self, symbols: np.ndarray, behind: int, q: int, last: bool) -> list[list[tuple[str, str | None]]]:
        """The edits of each turn, given the vector behind the symbols and the
        state before them; with those that end a conversation if they are its
        ``last``."""
        codes, rest = self._codes(symbols)
        size, v, ends = self.costs.block, behind, []
        for s in rest[::-1]:
            ends.append(v)
            v = int(self.next[s, v])
        blocks = []
        for code in codes[::-1]:
            blocks.append(v)
            v = int(self.block_next[code, v])
        out: list[list[tuple[str, str | None]]] = []
        for k, v in enumerate(reversed(blocks)):
            inside, own = symbols[k * size : (k + 1) * size], []
            for s in inside[::-1]:
                own.append(v)
                v = int(self.next[s, v])
            q = self._forward(inside, own[::-1], q, out)
        q = self._forward(rest, ends[::-1], q, out)
        if last and self.tail[q]:
            out[-1] = out[-1] + self.tail[q]
        return out

    def _forward(self, symbols: np.ndarray, behind: list[int], q: int, out: list) -> int:
        for s, v in zip(symbols.tolist(), behind):
            out.append(self.edits[s][v][q])
            q = int(self.exit[s, v, q])
        return q


@functools.lru_cache(maxsize=4)
def tables(costs: Costs) -> Tables:
    """Made once in each process."""
    return Tables(costs)
