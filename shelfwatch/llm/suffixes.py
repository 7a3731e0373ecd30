"""Suffixes of many short byte strings in order, by induced sorting over spilling bucket queues.

The strings are one text, each closed by a byte value below all others. Suffixes that start lower than
their successor and follow one that does not (S*) are sorted first; all others are induced: going up
through the first bytes, every suffix put out hands its predecessor to the queue of that one's first
byte if it is larger (L), then going down the smaller ones (S). A queue is filled in the order
in which it is read, so the queues together are a priority queue over (first byte, rank of the rest).
Queues above ``QUEUE_BYTES`` move to an unnamed file of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that the queues of one sort keep in memory.
QUEUE_BYTES = 64_000_000
#: A string's end and 256 byte values.
SYMBOLS = 257


class Queues:
    """First-in first-out queues of positions, one per symbol."""

    def __init__(self, symbols: int, limit: int = QUEUE_BYTES) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.file = 0, limit, None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.parts[symbol].append(positions)
        self.held += positions.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.file.seek(0, 2)
                    part.astype(np.int64).tofile(self.file)
                    parts[i] = (at, len(part))
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """Everything in a queue, in order; the queue is empty afterwards."""
        found = []
        for part in self.parts[symbol]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, np.int64, part[1])
            else:
                self.held -= part.nbytes
            found.append(part)
        self.parts[symbol] = []
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _hand_on(queues: Queues, symbols: np.ndarray, positions: np.ndarray) -> None:
    """Push positions to the queue of their own symbol, keeping their order."""
    if not len(positions):
        return
    own = symbols[positions]
    order = np.argsort(own, kind="stable")
    used, first = np.unique(own[order], return_index=True)
    for symbol, part in zip(used.tolist(), np.split(positions[order], first[1:]), strict=True):
        queues.push(symbol, part)


def _types(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (S)."""
    differs = np.append(symbols[:-1] != symbols[1:], True)
    rises = np.append(symbols[:-1] < symbols[1:], True)
    # A run of equal symbols has the type of its last one.
    last = np.flatnonzero(differs)
    return np.repeat(rises[last], np.diff(last, prepend=-1))


def sevens(symbols: np.ndarray) -> np.ndarray:
    """Every run of seven symbols as one number of 63 bits, by doubling."""
    one = symbols.astype(np.uint64)
    two = one[:-1] << np.uint64(9) | one[1:]
    three = two[:-1] << np.uint64(9) | one[2:]
    four = two[:-2] << np.uint64(18) | two[2:]
    return four[:-3] << np.uint64(27) | three[4:]


def sorted_suffixes(symbols: np.ndarray, depth: int, limit: int = QUEUE_BYTES, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix positions of ``symbols`` (uint16 up to 256, zero closes a string) in order of their first ``depth`` symbols.

    Suffixes that agree that far may come in any order among themselves. Strings end at zeros: what
    follows one is not compared. ``wanted`` holds for the first positions of each string: all of these are ordered,
    of the others only those that they are induced from.
    """
    n = len(symbols)
    is_s = _types(symbols)
    is_s[symbols == 0] = True
    star = np.flatnonzero(is_s & ~np.append(True, is_s[:-1]) | (symbols == 0)) if n else np.zeros(0, np.int64)
    if wanted is not None and len(star):
        # A suffix is induced, step by step, from the next S* suffix after it.
        star = star[np.append(True, wanted[star[:-1]] | (symbols[star[:-1]] == 0))]
    # S* suffixes by their first symbols, seven in a key; zeros part suffixes before what follows them counts.
    packed = sevens(np.append(symbols, np.zeros(depth + 16, symbols.dtype)))
    star = star[np.lexsort([packed[star + at] for at in range(0, depth, 7)][::-1])]

    seeds, larger, smaller = (Queues(SYMBOLS, limit) for _ in range(3))
    _hand_on(seeds, symbols, star)
    put_l: list[np.ndarray] = [np.zeros(0, np.int64)] * SYMBOLS
    for symbol in range(SYMBOLS):
        done = []
        while len(found := larger.pop(symbol)):
            done.append(found)
            before = found[found > 0] - 1
            _hand_on(larger, symbols, before[~is_s[before] & (symbols[before] >= symbol)])
        put_l[symbol] = np.concatenate(done) if done else put_l[symbol]
        found = seeds.pop(symbol)
        before = found[found > 0] - 1
        _hand_on(larger, symbols, before[~is_s[before]])
    out: list[np.ndarray] = []
    for symbol in range(SYMBOLS - 1, -1, -1):
        # Downwards, each queue runs from the largest suffix to the smallest.
        done = []
        while len(found := smaller.pop(symbol)):
            done.append(found)
            before = found[found > 0] - 1
            _hand_on(smaller, symbols, before[is_s[before] & (symbols[before] > 0) & (symbols[before] <= symbol)])
        found = put_l[symbol][::-1]
        before = found[found > 0] - 1
        _hand_on(smaller, symbols, before[is_s[before] & (symbols[before] > 0)])
        out.append(np.concatenate([*done, found]))
    for queues in (seeds, larger, smaller):
        queues.close()
    whole = np.concatenate(out)[::-1]
    return whole[symbols[whole] > 0]
