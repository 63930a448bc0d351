"""Vectorised rolling hashes over words and bytes (Rabin-Karp over integers modulo 2^64).

Prefix sums S[i] = sum of v[j] * B^j give any gram as (S[i+k] - S[i]) * B^-i; B is odd, so it
has an inverse. Values are mixed before use, and windows carry two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
MASK = (1 << 64) - 1


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^(n-1) and their inverses."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        base, size = BASES[which], max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        got = _powers[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray, which: int = 0) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U((0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9)[which])
    x ^= x >> U(29)
    x *= U((0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)[which])
    x ^= x >> U(32)
    return x


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values), which)[0], out=out[1:])
    return out


def grams(sums: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k values from every start."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * powers(n, which)[1], which) if n > 0 else np.zeros(0, dtype=U)


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for arrays of starts and ends."""
    return mix((sums[end] - sums[start]) * powers(len(sums), which)[1][start], which)


def sliding(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over every `width` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def slices(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes together; a longer row comes alone, whole."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


class Words:
    """The words (runs of bytes other than 0x20, 0x09-0x0D) of some texts, with a hash of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(SPACE[data].view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        sums = prefix(data.astype(U) + U(1))
        self.hash = spans(sums, self.start, self.end)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        #: words of text t are those from first[t] to first[t + 1]
        self.first = np.searchsorted(self.start, begin)
        self.sums = [prefix(mix(self.hash.copy(), w), w) for w in (0, 1)]

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each text's whole word sequence."""
        return tuple(spans(self.sums[w], self.first[:-1], self.first[1:], w) for w in (0, 1))

    def windows(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, text of each, anchor of each) of all windows of `size` words.

        The anchor is the least hash of the gram-word runs inside the window: equal windows
        have equal anchors, and neighbouring windows mostly share theirs.
        """
        least = sliding(grams(self.sums[0], gram), size - gram + 1)
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        shift = np.concatenate([[0], np.cumsum(counts)])[:-1]
        starts = np.arange(len(text)) - shift[text] + self.first[:-1][text]
        return starts, text, least[starts]
