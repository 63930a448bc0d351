"""Spatial joins as equi-joins on cells and squares; boxes only filter what the keys bring together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.constants import CELL_ZOOM
from quadloom.functions.geometry import boxes_touch
from quadloom.functions.tilemath import ancestors, cells, pixel_to_tile, shr, tile_bounds

BOX = ("min_x", "min_y", "max_x", "max_y")


def assign_cells(features: DataFrame) -> DataFrame:
    """One row per feature and storage cell that its box touches."""
    return features.withColumn("_c", F.explode(cells(*map(F.col, BOX)))).select(*features.columns, "_c.cell_x", "_c.cell_y")


def draw_box(prefix: str = "draw_") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def with_bounds(tile_set: DataFrame) -> DataFrame:
    return tile_set.withColumn("_b", tile_bounds(F.col("z"), F.col("x"), F.col("y"))).select(*tile_set.columns, "_b.*")


def tile_cells(tile_set: DataFrame) -> DataFrame:
    """(z, x, y, cell_x, cell_y): the storage cells that a tile covers or lies in."""
    z = F.col("z")
    up, down = F.greatest(z - CELL_ZOOM, F.lit(0)), F.greatest(CELL_ZOOM - z, F.lit(0))

    def span(v: str) -> Column:
        low = F.call_function("shiftleft", shr(F.col(v), up), down.cast("int"))
        return F.sequence(low, low + F.call_function("shiftleft", F.lit(1).cast("long"), down.cast("int")) - 1)

    return tile_set.withColumn("cell_x", F.explode(span("x"))).withColumn("cell_y", F.explode(span("y")))


def range_scan(store: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """Stored rows of the cells of one tile: constant ranges that reach the scan."""
    z, x, y = tile
    up, down = max(z - CELL_ZOOM, 0), max(CELL_ZOOM - z, 0)
    x0, y0 = (x >> up) << down, (y >> up) << down
    n = (1 << down) - 1
    return store.where(F.col("cell_x").between(x0, x0 + n) & F.col("cell_y").between(y0, y0 + n))


def match(store: DataFrame, tile_set: DataFrame) -> DataFrame:
    """Stored features (one row per cell) with the squares that draw them; a feature comes once per tile and cell.

    Deep squares (zoom >= 10) lie in one cell: an equi-join on it. For shallow squares a feature is
    lifted to the squares above its cell, at the zooms at which it shows, so the key is the tile
    itself and no list of up to 4^10 cells is made. Zoom and box filter the pairs.
    """
    spec = with_bounds(tile_set)
    deep = spec.where(F.col("z") >= CELL_ZOOM)
    up = (F.col("z") - CELL_ZOOM).cast("int")
    deep = deep.withColumns({"cell_x": shr(F.col("x"), up), "cell_y": shr(F.col("y"), up)})
    rest = [c for c in store.columns if c not in ("cell_x", "cell_y")]
    own = ["z", "x", "y", *[c for c in spec.columns if c not in ("z", "x", "y")]]
    low = store.join(deep, ["cell_x", "cell_y"]).select(*own[:3], *[spec_col for spec_col in own[3:] if spec_col.startswith("draw_")], *[store[c] for c in rest])
    shallow = spec.where(F.col("z") < CELL_ZOOM)
    lifted = store.where(F.col("min_z") < CELL_ZOOM)
    zooms = F.sequence(F.greatest(F.col("min_z"), F.lit(0)).cast("long"), F.least(F.col("max_z"), F.lit(CELL_ZOOM - 1)).cast("long"))
    lifted = lifted.withColumn("z", F.explode(zooms))
    drop = (CELL_ZOOM - F.col("z")).cast("int")
    lifted = lifted.withColumns({"x": shr(F.col("cell_x"), drop), "y": shr(F.col("cell_y"), drop)})
    high = lifted.join(shallow.select("z", "x", "y", *[c for c in own if c.startswith("draw_")]), ["z", "x", "y"]).select(*low.columns)
    both = low.unionByName(high)
    return both.where((F.col("min_z") <= F.col("z")) & (F.col("z") <= F.col("max_z")) & boxes_touch([F.col(c) for c in BOX], draw_box()))


def dedup_in_tile(rows: DataFrame, layer: str = "layer", kind: str = "geom_type") -> DataFrame:
    """One row per tile, layer, kind of geometry and id: the copies that cells made are equal."""
    return rows.dropDuplicates(["z", "x", "y", layer, kind, "id"])


def walk(queries: DataFrame, entries: DataFrame, least: int = 0) -> DataFrame:
    """(query, entry) pairs of squares where one is the other, above it or below it.

    Both directions are equi-joins: a query's ancestors meet entries, and entries' proper
    ancestors meet queries. Entry columns are prefixed by e.
    """
    e = entries.select(*[F.col(c).alias(f"e{c}") for c in entries.columns])
    up = queries.withColumn("_a", F.explode(ancestors(F.col("z"), F.col("x"), F.col("y"), least)))
    above = up.join(e, (F.col("_a.z") == F.col("ez")) & (F.col("_a.x") == F.col("ex")) & (F.col("_a.y") == F.col("ey"))).drop("_a")
    lifted = e.withColumn("_a", F.explode(ancestors(F.col("ez"), F.col("ex"), F.col("ey"), least))).where(F.col("_a.z") < F.col("ez"))
    below = queries.join(lifted, (F.col("_a.z") == F.col("z")) & (F.col("_a.x") == F.col("x")) & (F.col("_a.y") == F.col("y"))).drop("_a")
    return above.unionByName(below)


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    return pixel_to_tile(x, CELL_ZOOM), pixel_to_tile(y, CELL_ZOOM)
