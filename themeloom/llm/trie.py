"""A trie of many words at once, in arrays.

Words are sorted, so the nodes below a node stand together, as in a
depth-first walk, and a word opens new nodes only beyond the prefix it shares
with the word before it. ``nodes[i, d]`` is the node of the first ``d``
symbols of word ``i``; node 0 is the root. ``openers(d)`` are the words that
open the nodes of depth ``d``, one for each, so what is computed for them is
computed once for a shared prefix.
"""

import numpy as np

# Longest word that a trie takes, in symbols; longer ones are the caller's.
LONGEST = 64

# Highest bits of a hash by which a table is laid out: a few drawers for each string.
DRAWER_BITS = 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(LONGEST + 1, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(LONGEST):
        _POWERS[_i + 1] = _POWERS[_i] * _BASE


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of each row; column ``d`` is for ``d`` symbols."""
    hashes = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    with np.errstate(over="ignore"):
        for d in range(codes.shape[1]):
            hashes[:, d + 1] = hashes[:, d] * _BASE + mixed[:, d]
    return hashes


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    return codes, lengths


class Table:
    """Numbers of given strings of at most LONGEST symbols, by their hash."""

    def __init__(self, numbers: dict[str, int]) -> None:
        words = [word for word in numbers if len(word) <= LONGEST]
        codes, lengths = _codes(words)
        hashes = _prefix_hashes(codes)[np.arange(len(words)), lengths]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.numbers = np.array([numbers[word] for word in words], np.int64)[order]
        if len(words) and (np.diff(self.hashes) == 0).any():
            raise ValueError("two strings have one hash")
        self.lengths = set(lengths.tolist())
        self.longest = int(lengths.max(initial=0))
        # Where the hashes with each value of their highest bits begin.
        high = (self.hashes >> np.uint64(64 - DRAWER_BITS)).astype(np.int64)
        counts = np.bincount(high, minlength=1 << DRAWER_BITS)
        self.drawers = np.concatenate([[0], np.cumsum(counts)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, or -1 where there is no such string."""
        drawers = (hashes >> np.uint64(64 - DRAWER_BITS)).astype(np.int64)
        begins, ends = self.drawers[drawers], self.drawers[drawers + 1]
        found = np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(begins < ends)
        at, ends = begins[left], ends[left]
        while len(left):
            hit = self.hashes[at] == hashes[left]
            found[left[hit]] = self.numbers[at[hit]]
            more = ~hit & (at + 1 < ends)
            left, at, ends = left[more], at[more] + 1, ends[more]
        return found


class Trie:
    def __init__(self, words: list[str]) -> None:
        """``words`` are different, not empty, and no longer than LONGEST."""
        self.words = sorted(words)
        self.codes, self.lengths = _codes(self.words)
        n, longest = self.codes.shape
        self.hashes = _prefix_hashes(self.codes)
        same = (self.codes[1:] == self.codes[:-1]).cumprod(axis=1).sum(axis=1)
        shared = np.minimum(same, np.minimum(self.lengths[1:], self.lengths[:-1]))
        self.shared = np.concatenate([[0], shared]) if n else np.empty(0, np.int64)
        self.nodes = np.zeros((n, longest + 1), np.int32)
        self.size = 1
        self._openers = [np.empty(0, np.int64)]
        for d in range(1, longest + 1):
            opens = (self.lengths >= d) & (self.shared < d)
            self.nodes[:, d] = np.where(self.lengths >= d, self.size - 1 + np.cumsum(opens), 0)
            self._openers.append(np.flatnonzero(opens))
            self.size += len(self._openers[d])

    @property
    def depth(self) -> int:
        return self.codes.shape[1]

    def openers(self, d: int) -> np.ndarray:
        return self._openers[d]

    def part(self, rows: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` symbols from ``starts`` on."""
        with np.errstate(over="ignore"):
            before = self.hashes[rows, starts] * _POWERS[length]
            return self.hashes[rows, starts + length] - before
