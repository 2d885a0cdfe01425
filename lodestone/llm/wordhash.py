"""64-bit hashes of words and of runs of words, vectorised over many texts at once.

A word's hash is a polynomial of per-byte random values, a run's hash a polynomial of its
words' hashes, both modulo 2**64 from prefix sums and both mixed at the end. Two different
runs agree with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 19
_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = mix(np.arange(1, 257, dtype=_U) * _U(0x9FB21C651E98DF25))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.empty(0, _U)
    up, down = _words.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + _U(k))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run ``words[start:end]``."""
    up, down = _words.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it starts)."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = _GAP[raw]
    edge = np.diff(gap)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, _U), starts
    up, down = _bytes.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER if lower else _EXACT)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def hashed(texts: list[bytes | None], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of ``texts``: (index of the first, word hashes, word offsets of the texts: one more than texts)."""
    first, total = 0, 0
    for i, t in enumerate([*texts, None]):
        size = len(t or b"") + 1
        if i == len(texts) or (total and total + size > CHUNK):
            part = [x or b"" for x in texts[first:i]]
            if part:
                words, starts = word_hashes(b"\n".join(part), lower)
                at = np.zeros(len(part) + 1, np.int64)
                np.cumsum([len(x) + 1 for x in part], out=at[1:])
                yield first, words, np.searchsorted(starts, at)
            first, total = i, 0
        total += size
