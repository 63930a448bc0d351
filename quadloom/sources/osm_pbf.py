"""OSM PBF files as a Spark data source: one partition per run of blobs, read by seeking.

spark.dataSource.register(OsmPbfSource)
spark.read.format("osm_pbf").option("path", ...).load()

Columns: kind (node, way, relation), id, lat, lng, tags, refs (of a way), members (of a relation).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.operators import protobuf as pb

SCHEMA = "kind string, id long, lat double, lng double, tags map<string,string>, refs array<long>, members array<struct<kind:string,ref:long,role:string>>"
KINDS = ("node", "way", "relation")


def blob_headers(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset of the blob, size) of each blob; only headers are read."""
    with open(path, "rb") as f:
        end = os.fstat(f.fileno()).st_size
        at = 0
        while at < end:
            f.seek(at)
            (n,) = struct.unpack(">I", f.read(4))
            head = {k: v for k, _, v in pb.fields(f.read(n))}
            at += 4 + n
            yield head[1].decode(), at, head[3]
            at += head[3]


def _unpack(blob: bytes) -> bytes:
    found = {k: v for k, _, v in pb.fields(blob)}
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("only raw and zlib blobs are read")


def _running(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += pb.unzigzag(v)
        out.append(at)
    return out


def primitives(block: bytes) -> Iterator[tuple]:
    """Rows of a primitive block."""
    strings: list[str] = []
    groups: list[bytes] = []
    granularity, lat0, lng0 = 100, 0, 0
    for k, _, v in pb.fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for f, _, s in pb.fields(v) if f == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == 20:
            lng0 = v - (1 << 64) if v >> 63 else v
    degrees = lambda v, o: 1e-9 * (o + granularity * v)

    def tags(f: dict) -> dict[str, str]:
        return {strings[a]: strings[b] for a, b in zip(pb.numbers(f.get(2, b"")), pb.numbers(f.get(3, b"")))}

    for group in groups:
        for k, _, v in pb.fields(group):
            f = {a: b for a, _, b in pb.fields(v)}
            if k == 1:
                yield "node", pb.unzigzag(f[1]), degrees(pb.unzigzag(f[8]), lat0), degrees(pb.unzigzag(f[9]), lng0), tags(f), None, None
            elif k == 2:
                ids, lats, lngs = (_running(pb.numbers(f.get(i, b""))) for i in (1, 8, 9))
                codes, at = pb.numbers(f.get(10, b"")), 0
                for i, la, lo in zip(ids, lats, lngs):
                    own = {}
                    while at < len(codes) and codes[at]:
                        own[strings[codes[at]]] = strings[codes[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, degrees(la, lat0), degrees(lo, lng0), own, None, None
            elif k == 3:
                yield "way", f[1], None, None, tags(f), _running(pb.numbers(f.get(8, b""))), None
            elif k == 4:
                roles, refs, kinds = pb.numbers(f.get(8, b"")), _running(pb.numbers(f.get(9, b""))), pb.numbers(f.get(10, b""))
                yield "relation", f[1], None, None, tags(f), None, [(KINDS[t], r, strings[s]) for s, r, t in zip(roles, refs, kinds)]


class _Blobs(InputPartition):
    def __init__(self, path: str, blobs: list[tuple[int, int]]):
        self.path, self.blobs = path, blobs


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(str(p) for p in Path(path).glob("*.pbf")) if Path(path).is_dir() else [path]
        self.per_task = int(options.get("blobsPerTask", 16))

    def partitions(self):
        parts = []
        for path in self.paths:
            found = [(at, n) for kind, at, n in blob_headers(path) if kind == "OSMData"]
            parts += [_Blobs(path, found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]
        return parts or [_Blobs("", [])]

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        if partition.blobs:
            with open(partition.path, "rb") as f:
                for at, n in partition.blobs:
                    f.seek(at)
                    yield from primitives(_unpack(f.read(n)))


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


# -- a writer, for fixtures and exports of small extracts ---------------------------------


def write(path: str, rows: Iterable[tuple], per_block: int = 1000) -> None:
    """rows in the order of SCHEMA's columns; nodes are written dense. One block of them is held at a time."""
    rows = iter(rows)

    def blob(kind: str, data: bytes) -> bytes:
        body = pb.number(2, len(data)) + pb.message(3, zlib.compress(data))
        head = pb.message(1, kind.encode()) + pb.number(3, len(body))
        return struct.pack(">I", len(head)) + head + body

    def steps(values: list[int]) -> list[int]:
        return [pb.zigzag(b - a) for a, b in zip([0, *values], values)]

    with open(path, "wb") as out:
        out.write(blob("OSMHeader", pb.message(4, b"OsmSchema-V0.6") + pb.message(4, b"DenseNodes")))
        while block := list(islice(rows, per_block)):
            codes: dict[str, int] = {"": 0}
            code = lambda s: codes.setdefault(s, len(codes))  # noqa: B023, E731
            nodes, groups = [], bytearray()
            for kind, i, lat, lng, tags, refs, members in block:
                if kind == "node":
                    nodes.append((i, round(lat * 1e7), round(lng * 1e7), tags))
                    continue
                body = pb.number(1, i) + pb.packed(2, map(code, tags)) + pb.packed(3, map(code, tags.values()))
                if kind == "way":
                    groups += pb.message(2, pb.message(3, body + pb.packed(8, steps(refs))))
                else:
                    body += pb.packed(8, [code(m[2]) for m in members]) + pb.packed(9, steps([m[1] for m in members])) + pb.packed(10, [KINDS.index(m[0]) for m in members])
                    groups += pb.message(2, pb.message(4, body))
            if nodes:
                words = [c for n in nodes for c in (*[code(s) for kv in n[3].items() for s in kv], 0)]
                dense = b"".join(pb.packed(f, steps([n[k] for n in nodes])) for f, k in ((1, 0), (8, 1), (9, 2))) + pb.packed(10, words)
                groups = pb.message(2, pb.message(2, dense)) + groups
            out.write(blob("OSMData", pb.message(1, b"".join(pb.message(1, s.encode()) for s in codes)) + groups))
