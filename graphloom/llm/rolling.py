"""Rolling polynomial hashes of runs of words: any run of a list of texts in constant time.

Sums of word hashes times powers of an odd base modulo 2**64 are kept from the first word on; a run's hash is the
difference of two sums, divided by the power at its start.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base modulo 2**64 and of its inverse, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


class WordHash(dict):
    """XXH64 of words, held for up to ``most`` of them; never 0."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 1) or 1
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Running sums over word hashes."""

    def __init__(self, words: np.ndarray):
        up, self.down = POWERS(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the runs from ``starts`` to ``ends``, exclusive."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Texts:
    """Word hashes of a list of texts, laid end to end, with their running sums."""

    def __init__(self, texts: list[str | None], words_of: Callable[[str], list[str]], hashes: WordHash):
        words = [words_of(t) if t else [] for t in texts]
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.counts) - self.counts
        self.words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(self.counts.sum()))
        self.runs = Sums(self.words).runs

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``length`` words, and the text each lies in."""
        each = np.maximum(self.counts - length + 1, 0)
        text = np.repeat(np.arange(len(each)), each)
        return self.begins[text] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each), text
