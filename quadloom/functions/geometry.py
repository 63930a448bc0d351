"""Geometry as arrays of struct<x, y>: expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.constants import MAX_ZOOM
from quadloom.functions.tilemath import shr


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: lambdas that name an expression compute it for each element."""
    return F.transform(F.array(value), body)[0]


def consecutive_dedup(points: Column) -> Column:
    """points without those equal to the one right before."""
    return let(points, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1) != p)))


def quantize(points: Column, z: Column) -> Column:
    """Pixels at zoom z; neighbours that fall together are one."""
    moved = F.transform(points, lambda p: xy(shr(p["x"], MAX_ZOOM - z), shr(p["y"], MAX_ZOOM - z)))
    return consecutive_dedup(moved)


def quantize_line(points: Column, z: Column) -> Column:
    """Null if fewer than two points are left."""
    q = quantize(points, z)
    return F.transform(F.array(q), lambda p: F.when(F.size(p) >= 2, p))[0]


def quantize_ring(points: Column, z: Column) -> Column:
    """Null if fewer than three points are left."""
    q = quantize(points, z)
    return F.transform(F.array(q), lambda p: F.when(F.size(p) >= 3, p))[0]


def in_box(x: Column, y: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Strictly inside: points on an edge are out."""
    return (x > min_x) & (x < max_x) & (y > min_y) & (y < max_y)


def boxes_touch(a: list[Column], b: list[Column]) -> Column:
    """Inclusive overlap of (min_x, min_y, max_x, max_y)."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_within(a: list[Column], b: list[Column]) -> Column:
    """a lies in b, edges included."""
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.array(xy(min_x, min_y), xy(max_x, min_y), xy(max_x, max_y), xy(min_x, max_y))


def close_ring(points: Column) -> Column:
    """The ring with its first point at its end too."""
    return let(points, lambda p: F.when((F.size(p) > 0) & (F.element_at(p, 1) != F.element_at(p, -1)), F.concat(p, F.slice(p, 1, 1))).otherwise(p))


def ring_ok(points: Column, least: int = 4) -> Column:
    return F.size(points) >= least


def doubled_area(points: Column) -> Column:
    """Twice the signed area of a closed ring, relative to its first point so that products stay small."""

    def terms(ps: Column) -> Column:
        o = F.element_at(ps, 1)
        return F.zip_with(ps, F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), lambda p, q: F.coalesce((p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]), F.lit(0).cast("long")))

    return F.aggregate(let(points, terms), F.lit(0).cast("long"), lambda a, t: a + t)


def ring_area(points: Column) -> Column:
    """Area of a closed ring whatever its orientation."""
    return F.call_function("shiftright", F.abs(doubled_area(points)), F.lit(1))


def bounding_box(points: Column) -> Column:
    def box(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))

    return let(points, box)


def deltas(values: Column, origin: Column | int = 0) -> Column:
    """Each value less the one before; the first less the origin."""
    start = F.lit(origin).cast("long") if isinstance(origin, int) else origin
    return F.transform(values, lambda v, i: v - F.when(i == 0, start).otherwise(F.get(values, i - 1)))


def undelta(steps: Column, origin: Column | int = 0) -> Column:
    start = F.lit(origin).cast("long") if isinstance(origin, int) else origin
    empty = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(steps, empty, lambda a, d: F.struct((a["at"] + d).alias("at"), F.concat(a["out"], F.array(a["at"] + d)).alias("out")))["out"]


def zigzag(v: Column) -> Column:
    return F.call_function("shiftleft", v, F.lit(1)).bitwiseXOR(F.call_function("shiftright", v, F.lit(63)))


def command(kind: Column | int, count: Column) -> Column:
    """Vector-tile command integer: the kind in three bits, then the count."""
    k = F.lit(kind) if isinstance(kind, int) else kind
    return k.cast("long").bitwiseAND(F.lit(7).cast("long")).bitwiseOR(F.call_function("shiftleft", count.cast("long"), F.lit(3)))
