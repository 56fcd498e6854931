"""Vectorised tokenising of whole batches of text.

A batch of texts is laid out as one array of code points.  Word limits, word
hashes and n-gram hashes are then array operations over the whole batch, so
the cost a word is some tens of nanoseconds and no Python object is made for a
word.  Hashes are 64-bit and the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters laid out at once; bounds the memory of a batch, not the length of a text.
BATCH_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 no part of a word, 1 letter or digit, 2 Han ideograph."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[: 0x30000] = np.fromiter((chr(c).isalnum() for c in range(0x30000)), dtype=np.uint8, count=0x30000)
    for low, high in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        table[low : high + 1] = 2
    return table


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BATCH_CHARS // 4)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of a hash may be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: hash and text number of each, in order.

    ``han_single``: every ideograph is a word of its own; else it counts as a
    letter.  ``per_char``: every letter, digit and ideograph is a word.  Words
    are runs of letters and digits; case does not count.  Null texts have none.
    """

    def __init__(self, texts: list[str | None], han_single: bool = True, per_char: bool = False):
        low = [(t or "").lower() for t in texts]
        lengths = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
        self.n_texts = len(low)
        points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _classes()[points]
        if not han_single:
            kind = (kind > 0).astype(np.uint8)
        before = np.empty_like(kind)
        before[0] = 0
        before[1:] = kind[:-1]
        after = np.empty_like(kind)
        after[-1] = 0
        after[:-1] = kind[1:]
        if per_char:
            start = np.flatnonzero(kind)
            end = start + 1
        else:
            start = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
            end = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
        power, inverse = _power_tables(len(points))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        self.hash = mix((sums[end] - sums[start]) * inverse[start])
        ends = np.cumsum(lengths)
        self.offsets = np.zeros(len(low) + 1, dtype=np.int64)
        self.offsets[1:] = np.searchsorted(start, ends)
        self.text = np.repeat(np.arange(len(low)), np.diff(self.offsets))

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.offsets[i] : self.offsets[i + 1]]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that lie in one text, and where they start."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        out = self.hash[:count].copy()
        for k in range(1, n):
            out = out * _GRAM + self.hash[k : k + count]
        at = np.flatnonzero(self.text[:count] == self.text[n - 1 :])
        return mix(out[at]), at

    def whole(self, seed: int = 0) -> np.ndarray:
        """A hash of each whole text as a sequence of words; 0 words hash to 0."""
        if not len(self.hash):
            return np.zeros(self.n_texts, dtype=np.uint64)
        at = np.arange(len(self.hash)) - self.offsets[self.text]
        power, _ = _power_tables(int(at.max()) + 1)
        sums = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum((self.hash ^ np.uint64(seed)) * power[at], out=sums[1:])
        return np.where(np.diff(self.offsets) > 0, mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]] + np.diff(self.offsets).astype(np.uint64)), np.uint64(0))


def slices(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
