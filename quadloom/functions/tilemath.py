"""Slippy-tile arithmetic on (z, x, y) columns of longs; everything is whole-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.constants import CELL_ZOOM, MAX_ZOOM, OVERDRAW, TILE_BITS


def shr(v: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", v.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def shl(v: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", v.cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def pixel_to_tile(v: Column, z: Column | int) -> Column:
    """Tile coordinate at zoom z of a pixel at zoom 20."""
    return shr(v, MAX_ZOOM + TILE_BITS - z)


def tile_to_key(z: Column, x: Column, y: Column, n: Column) -> Column:
    """z 5 bits, y 21, x 21, n 17. From z = 16 on the key is negative as a signed long."""
    return shl(z, 59).bitwiseOR(shl(y, 38)).bitwiseOR(shl(x, 17)).bitwiseOR(n.cast("long"))


def key_to_tile(key: Column) -> Column:
    part = lambda n, bits: F.call_function("shiftrightunsigned", key, F.lit(n)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.struct(part(59, 5).alias("z"), part(17, 21).alias("x"), part(38, 21).alias("y"), part(0, 17).alias("n"))


def tile_bounds(z: Column, x: Column, y: Column, overdraw: int = OVERDRAW) -> Column:
    """struct of the insert box and the draw box (insert box widened by overdraw) at zoom 20, both inclusive."""
    size = MAX_ZOOM + TILE_BITS - z
    lo = {"x": shl(x, size), "y": shl(y, size)}
    hi = {"x": shl(x + 1, size), "y": shl(y + 1, size)}
    insert = [lo[a].alias(f"min_{a}") for a in "xy"] + [hi[a].alias(f"max_{a}") for a in "xy"]
    draw = [(lo[a] - overdraw).alias(f"draw_min_{a}") for a in "xy"] + [(hi[a] + overdraw).alias(f"draw_max_{a}") for a in "xy"]
    return F.struct(*insert, *draw)


def tile_exists(z: Column, x: Column, y: Column) -> Column:
    side = shl(F.lit(1), F.greatest(F.least(z, F.lit(MAX_ZOOM)), F.lit(0)))
    return (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def require_tile(z: Column, x: Column, y: Column) -> Column:
    """True, or an error that names the tile."""
    return F.when(tile_exists(z, x, y), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such tile: "), F.concat_ws("/", z, x, y))).cast("boolean"))


def parent(z: Column, x: Column, y: Column) -> Column:
    return F.struct((z - 1).alias("z"), shr(x, 1).alias("x"), shr(y, 1).alias("y"))


def quad_pos(x: Column, y: Column) -> Column:
    """0 = (min y, min x), 1 = (min y, max x), 2 = (max y, min x), 3 = (max y, max x)."""
    return y.bitwiseAND(F.lit(1).cast("long")) * 2 + x.bitwiseAND(F.lit(1).cast("long"))


def children(z: Column, x: Column, y: Column) -> Column:
    """The four squares below, in order of quad_pos."""
    return F.array(*[F.struct((z + 1).alias("z"), (x * 2 + i % 2).alias("x"), (y * 2 + i // 2).alias("y")) for i in range(4)])


def ancestors(z: Column, x: Column, y: Column, least: int = 0) -> Column:
    """The tile itself and those above it, from zoom `least` down."""
    return F.transform(F.sequence(F.lit(least).cast("long"), z), lambda a: F.struct(a.alias("z"), shr(x, z - a).alias("x"), shr(y, z - a).alias("y")))


def cells(min_x: Column, min_y: Column, max_x: Column, max_y: Column, z: int = CELL_ZOOM) -> Column:
    """Every tile of zoom z that a box touches, both ends included."""
    xs = F.sequence(pixel_to_tile(min_x, z), pixel_to_tile(max_x, z))
    ys = F.sequence(pixel_to_tile(min_y, z), pixel_to_tile(max_y, z))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("cell_x"), y.alias("cell_y")))))


def best_tile(cell_x: Column, cell_y: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column, root_z: int = CELL_ZOOM, deepest: int = MAX_ZOOM - 1) -> Column:
    """The smallest tile at or below the cell whose children a box doesn't part.

    Down from the cell, a box goes to the lower or upper half of each axis only if it lies
    strictly on one side of the middle: the edges belong to both children.
    """

    def side(lo: Column, hi: Column, mid: Column) -> Column:
        return F.when(hi < mid, F.lit(0)).when(lo > mid, F.lit(1)).otherwise(F.lit(-1)).cast("long")

    def step(t: Column, z: Column) -> Column:
        half = MAX_ZOOM + TILE_BITS - z - 1
        sx = side(min_x, max_x, shl(t["x"] * 2 + 1, half))
        sy = side(min_y, max_y, shl(t["y"] * 2 + 1, half))
        down = (t["open"] == 1) & (sx >= 0) & (sy >= 0)
        return F.struct(
            F.when(down, z + 1).otherwise(t["z"]).alias("z"), F.when(down, t["x"] * 2 + sx).otherwise(t["x"]).alias("x"), F.when(down, t["y"] * 2 + sy).otherwise(t["y"]).alias("y"), F.when(down, F.lit(1)).otherwise(F.lit(0)).alias("open")
        )

    start = F.struct(F.lit(root_z).cast("long").alias("z"), cell_x.cast("long").alias("x"), cell_y.cast("long").alias("y"), F.lit(1).alias("open"))
    return F.aggregate(F.sequence(F.lit(root_z).cast("long"), F.lit(deepest).cast("long")), start, step, lambda t: F.struct(t["z"], t["x"], t["y"]))


def quad_key(z: Column, x: Column, y: Column, root_z: int = CELL_ZOOM) -> Column:
    """The quad positions from the root cell down to the tile, as a string; empty for the root."""
    steps = F.when(z > root_z, F.sequence(F.lit(root_z + 1).cast("long"), z)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.array_join(F.transform(steps, lambda a: quad_pos(shr(x, z - a), shr(y, z - a)).cast("string")), "")
