"""Mapbox Vector Tiles: encoder, decoder, and the operator that makes one tile per group of rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quadloom.constants import BOOL_FALSE, BOOL_TRUE, EXTENT, INTEGER, LINE, NUMERIC, POINT, POLYGON, STRING
from quadloom.operators import protobuf as pb

MOVE, DRAW, CLOSE = 1, 2, 7


def command(kind: int, count: int) -> int:
    return kind & 7 | count << 3


def encode_geometry(kind: int, parts: list[list[list[tuple[int, int]]]], origin: tuple[int, int]) -> list[int]:
    """Commands of a geometry; the pen goes on between parts and rings."""
    out: list[int] = []
    pen = list(origin)

    def go(points):
        for x, y in points:
            dx, dy = x - pen[0], y - pen[1]
            out.extend((pb.zigzag(dx), pb.zigzag(dy)))
            pen[:] = x, y

    if kind == POINT:
        points = [p for part in parts for ring in part for p in ring]
        out.append(command(MOVE, len(points)))
        go(points)
        return out
    for part in parts:
        for ring in part:
            if kind == POLYGON and ring[0] != ring[-1]:
                ring = [*ring, ring[0]]
            if any(a == b for a, b in zip(ring, ring[1:])):
                raise ValueError("a line stands still")
            end = len(ring) - 1 if kind == POLYGON else len(ring)
            out.append(command(MOVE, 1))
            go(ring[:1])
            out.append(command(DRAW, end - 1))
            go(ring[1:end])
            if kind == POLYGON:
                out.append(command(CLOSE, 1))
    return out


def encode_value(v: dict) -> bytes:
    kind = v["vtype"]
    if kind in (BOOL_FALSE, BOOL_TRUE):
        return pb.number(7, int(kind == BOOL_TRUE))
    if kind == STRING:
        return pb.message(1, v["s"].encode())
    if kind == NUMERIC:
        return pb.double(3, v["d"])
    if kind == INTEGER:
        return pb.number(6, pb.zigzag(int(v["i"])))
    raise ValueError(f"unknown value type {kind}")


def encode_layer(name: str, features: list[dict], origin: tuple[int, int]) -> bytes:
    """features: dicts of id, geom_type, parts, meta (list of (key, value)); codes are given in order of first use."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body: list[bytes] = []  # bytes that are added up are copied each time
    for f in features:
        tags = []
        for key, value in f["meta"]:
            if key == "layer" or key.startswith("__"):
                continue
            tags += [keys.setdefault(key, len(keys)), values.setdefault(encode_value(value), len(values))]
        body.append(pb.message(2, pb.number(3, f["geom_type"]) + pb.packed(4, encode_geometry(f["geom_type"], f["parts"], origin)) + pb.number(1, f["id"]) + pb.packed(2, tags)))
    head = pb.number(15, 2) + pb.message(1, name.encode()) + pb.number(5, EXTENT)
    return head + b"".join(body) + b"".join(pb.message(3, k.encode()) for k in keys) + b"".join(pb.message(4, v) for v in values)


def encode_tile(layers: list[tuple[str, list[dict]]], origin: tuple[int, int]) -> bytes:
    return b"".join(pb.message(3, encode_layer(n, f, origin)) for n, f in layers if f)


def decode_geometry(kind: int, commands: list[int]) -> list[list[tuple[int, int]]]:
    """Rings, lines or, for points, one list, relative to the tile's corner."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == CLOSE:
            out[-1].append(out[-1][0])
            continue
        for _ in range(count):
            x, y = x + pb.unzigzag(commands[at]), y + pb.unzigzag(commands[at + 1])
            at += 2
            if what == MOVE and (kind != POINT or not out):
                out.append([])
            out[-1].append((x, y))
    return out


def decode_tile(data: bytes) -> list[dict]:
    """Layers as dicts; fields may come in any order."""
    layers = []
    for field, _, raw in pb.fields(data):
        if field != 3:
            raise ValueError("not a tile")
        layer: dict = {"version": None, "name": None, "extent": None, "features": []}
        keys, values, features = [], [], []
        for f, _, v in pb.fields(raw):
            if f == 15:
                layer["version"] = v
            elif f == 1:
                layer["name"] = v.decode()
            elif f == 5:
                layer["extent"] = v
            elif f == 3:
                keys.append(v.decode())
            elif f == 4:
                (k, _, x), *_ = pb.fields(v)
                values.append({1: lambda: x.decode(), 3: lambda: struct.unpack("<d", x)[0], 6: lambda: pb.unzigzag(x), 7: lambda: bool(x)}[k]())
            elif f == 2:
                features.append(dict((a, c) for a, _, c in pb.fields(v)))
            else:
                raise ValueError(f"unknown layer field {f}")
        for f in features:
            tags = pb.numbers(f.get(2, b""))
            layer["features"].append({"id": f[1], "type": f[3], "geometry": decode_geometry(f[3], pb.numbers(f[4])), "tags": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}})
        layers.append(layer)
    return layers


def _plain(parts) -> list[list[list[tuple[int, int]]]]:
    return [[[(int(p["x"]), int(p["y"])) for p in ring] for ring in part] for part in parts]


def _tile(compress: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z, x, y = map(int, key)
        rows = rows.sort_values(["layer_idx", "id", "geom_type"])
        layers: dict[str, list[dict]] = {}
        for r in rows.to_dict("records"):
            meta = [(m["key"], m["value"]) for m in r["meta"]]
            layers.setdefault(r["layer"], []).append({"id": int(r["id"]), "geom_type": int(r["geom_type"]), "parts": _plain(r["parts"]), "meta": meta})
        data = encode_tile(list(layers.items()), (x * EXTENT, y * EXTENT))
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "n_features": [len(rows)], "mvt": [zlib.compress(data, 9) if compress else data]})

    return run


def encode_tiles(features: DataFrame, compress: bool = True) -> DataFrame:
    """(z, x, y, n_features, mvt) of rendered features (z, x, y, layer, layer_idx, id, geom_type, parts, meta).

    A tile is one group: what survives the zoom and box predicates of one tile, a few thousand
    features by design of the profile's lowest zooms.
    """
    rows = features.select("z", "x", "y", "layer", "layer_idx", "id", F.col("geom_type").cast("int").alias("geom_type"), "parts", "meta")
    return rows.groupBy("z", "x", "y").applyInPandas(_tile(compress), "z long, x long, y long, n_features long, mvt binary")


@F.pandas_udf(ArrayType(LongType()))
def line_commands(s: pd.Series) -> pd.Series:
    """The commands of each line (array of points), from the tile's corner at (0, 0)."""
    return s.map(lambda line: encode_geometry(LINE, [[[(int(p["x"]), int(p["y"])) for p in line]]], (0, 0)))


def inflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(zlib.decompress)
