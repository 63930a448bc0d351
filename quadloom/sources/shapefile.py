"""Polygons of a zipped shapefile: the first *.shp of each archive, one row per shape.

A shape's first part is the outer ring and every later part a hole, as the format's users here
have it. Archives are read through binaryFile, a task per archive.
"""

from __future__ import annotations

import io
import shutil
import struct
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import accumulate, batched, chain
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

POLYGON = 5
SCHEMA = "shape long, rings array<array<struct<lng:double,lat:double>>>"


def shapes(data: bytes | BinaryIO) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(number, rings) of the polygons of a .shp file, read record by record."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    f.read(100)
    while len(head := f.read(8)) == 8:
        number, words = struct.unpack(">ii", head)
        body = f.read(2 * words)
        if struct.unpack("<i", body[:4])[0] != POLYGON:
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        begin = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2]))
        yield number, [points[a:b] for a, b in zip(begin, begin[1:])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ring = pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())]))
    for batch in batches:
        for content in (v.as_py() for v in batch.column(0)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = next((n for n in z.namelist() if n.endswith(".shp")), None)
                if name is None:
                    raise ValueError("no .shp in the archive")
                with z.open(name) as f:
                    for part in batched(shapes(f), 512):
                        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([[[{"lng": x, "lat": y} for x, y in r] for r in rings] for _, rings in part], pa.list_(ring))], ["shape", "rings"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, SCHEMA)


def write(path: str, polygons: Iterable[list[list[tuple[float, float]]]]) -> None:
    """A zipped shapefile of polygons, for fixtures. Shapes go through a file: the head names their size."""
    with tempfile.TemporaryFile() as body:
        for i, rings in enumerate(polygons):
            body.write(_record(i + 1, rings))
        size = body.tell()
        body.seek(0)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("land.shp", "w", force_zip64=True) as out:
            out.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", 1000, POLYGON, *[0.0] * 8))
            shutil.copyfileobj(body, out, 1 << 20)


def _record(number: int, rings: list[list[tuple[float, float]]]) -> bytes:
    points = [p for r in rings for p in r]
    begin = [0, *accumulate(map(len, rings))][:-1]
    box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
    data = struct.pack("<i4d2i", POLYGON, *box, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *begin) + struct.pack(f"<{2 * len(points)}d", *chain.from_iterable(points))
    return struct.pack(">ii", number, len(data) // 2) + data
