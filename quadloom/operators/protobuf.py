"""The wire format of protocol buffers: just what vector map squares and OSM files need."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def tag(field: int, kind: int) -> bytes:
    return varint(field << 3 | kind)


def message(field: int, data: bytes) -> bytes:
    return tag(field, BYTES) + varint(len(data)) + data


def number(field: int, n: int) -> bytes:
    return tag(field, VARINT) + varint(n)


def double(field: int, v: float) -> bytes:
    return tag(field, FIXED64) + struct.pack("<d", v)


def packed(field: int, values: Iterable[int]) -> bytes:
    return message(field, b"".join(map(varint, values)))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, kind, value) of a message."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = read_varint(data, at)
        elif kind == BYTES:
            n, at = read_varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == FIXED64:
            value, at = data[at : at + 8], at + 8
        elif kind == FIXED32:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"unknown wire kind {kind}")
        yield key >> 3, kind, value


def numbers(data: bytes) -> list[int]:
    """A packed list of varints."""
    out, at = [], 0
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(n)
    return out
