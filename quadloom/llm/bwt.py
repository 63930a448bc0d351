"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

After Holt and McMillan (2014): shards are sorted by themselves; merged order is found without
their suffixes. An interleave says from which shard each place of the merged order comes. At
first it is any; reading the next character of each shard's transform in interleave order and
sorting stably by it gives the interleave by one more character. Where two neighbours first
part at step h, their common prefix is h - 1 long, so common prefixes come with the merge.

A character may be `stride` bytes: a transform then holds what stands `stride` bytes before
each rotation, and each step refines by as many.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int, stride: int = 1) -> np.ndarray:
    """Rotations in order of at least their first `depth` characters (prefix doubling); codes rank the first `stride`."""
    n = len(codes)
    rank, h = codes.astype(np.int64), stride
    order = np.argsort(codes, kind="stable")
    while h < depth:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -h % n)
        order = np.argsort(key, kind="stable")
        key = key[order]
        place = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = place
        h *= 2
        if place[-1] == n - 1:
            break
    return order


class Shard:
    """Some strings, each closed by a zero (bytes are shifted by one; UTF-8 has no 0xFF), their order and transform."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8) + np.uint8(1)  # 0xFF wraps to zero
        self.begin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)

    def transform(self, codes: np.ndarray, depth: int, stride: int) -> None:
        self.order = suffix_order(codes, depth, stride)
        self.bwt = codes[self.order - stride]  # what stands before each rotation


def build(parts: list[list[bytes]], depth: int, stride: int = 1) -> tuple[list[Shard], int]:
    """Shards of the parts over characters of `stride` bytes (or fewer, where 16 bits can't number those that occur)."""
    shards = [Shard(p) for p in parts]
    edge = np.cumsum([len(s.text) for s in shards])[:-1]
    while True:
        stride = 1 if depth % stride or min(len(s.text) for s in shards) < stride else stride
        value = np.concatenate([s.text for s in shards]).astype(np.uint64)
        if stride > 1:
            grams = []
            for s in shards:
                g = np.zeros(len(s.text), dtype=np.uint64)
                for k in range(stride):
                    g = g << np.uint64(8) | np.roll(s.text, -k)
                grams.append(g)
            value = np.concatenate(grams)
        names, codes = np.unique(value, return_inverse=True)
        if len(names) <= 1 << 16:
            break
        stride //= 2
    for s, c in zip(shards, np.split(codes.astype(np.uint16), edge)):
        s.transform(c, depth, stride)
    return shards, stride


def merge(shards: list[Shard], depth: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each place of the merged order, common prefix of each place with the one before).

    The common prefix is at most depth, and a multiple of the stride (rounded down).
    """
    sizes = [len(s.text) for s in shards]
    n = sum(sizes)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    block, lcp = np.zeros(n, dtype=np.int32), np.full(n, depth, dtype=np.int32)
    chars = np.empty(n, dtype=np.uint16)
    known = np.zeros(n, dtype=bool)
    for h in range(stride, depth + 1, stride):
        for i, s in enumerate(shards):
            chars[z == i] = s.bwt
        order = np.argsort(chars, kind="stable")
        z, c, b = z[order], chars[order], block[order]
        parts = np.empty(n, dtype=bool)
        parts[:1] = True
        np.not_equal(c[1:], c[:-1], out=parts[1:])
        parts[1:] |= b[1:] != b[:-1]
        lcp[parts & ~known] = h - stride
        known = parts
        if parts.all():
            break
        block = np.cumsum(parts, dtype=np.int32)
    return z, lcp


def repeated(strings: list[bytes], depth: int, shards: int = 2, stride: int = 8) -> list[np.ndarray]:
    """For each string, the starts of `depth`-long substrings that start elsewhere in the strings too."""
    k = max(1, min(shards, len(strings)))
    while depth % stride:
        stride //= 2
    made, stride = build([strings[i::k] for i in range(k)], depth, stride)
    z, lcp = merge(made, depth, stride)
    again = lcp >= depth
    again[:-1] |= again[1:]
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(strings)
    for i, s in enumerate(made):
        at = np.sort(s.order[again[z == i]])
        own = np.searchsorted(s.begin, at, side="right") - 1
        inside = at + depth < s.begin[own + 1]  # the closing zero isn't part of a substring
        at, own = at[inside], own[inside]
        edge = np.searchsorted(own, np.arange(len(s.begin)))
        for j in range(len(s.begin) - 1):
            found[i + j * k] = at[edge[j] : edge[j + 1]] - s.begin[j]
    return found
