"""The store and the squares made from it: import, request, prepare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.constants import CELL_ZOOM, LINE, POINT
from quadloom.functions.geometry import bounding_box
from quadloom.functions.tilemath import best_tile, quad_key, require_tile
from quadloom.operators import shapes, spatial
from quadloom.operators.mvt import encode_tiles
from quadloom.operators.tilesets import covered
from quadloom.plans.profile import DEFAULT, Profile, classify


@dataclass(frozen=True)
class Flags:
    """How squares are drawn. Prepared squares merge lines and leave out the open sea; served ones don't."""

    compress: bool = True
    ignore_prepared: bool = False
    ignore_fully_seaside: bool = False
    debug: bool = False
    aggregate_lines: bool = False
    aggregate_polygons: bool = False
    drop_subpixel: bool = True


PREPARE = Flags(ignore_fully_seaside=True, aggregate_lines=True, aggregate_polygons=True)


def import_features(features: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Classified features of the three kinds, with their boxes, one row for each storage cell."""
    kinds = ((1, profile.node), (2, profile.way), (3, profile.area))
    out = None
    for kind, rules in kinds:
        part = classify(features.where((F.col("geom_type") == kind) & (F.size("parts") > 0)), rules, area="area")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("_b", bounding_box(F.flatten(F.flatten("parts")))).select("id", "layer", "min_z", "max_z", "meta", "geom_type", "parts", "_b.*")
    return spatial.assign_cells(out)


def write_store(store: DataFrame, path: str) -> None:
    """Files sorted by cell, lowest zoom and quad key: cell and zoom predicates skip row groups."""
    best = best_tile(F.col("cell_x"), F.col("cell_y"), *[F.col(c) for c in spatial.BOX])
    rows = store.withColumn("_t", best).withColumn("quad_key", quad_key(F.col("_t.z"), F.col("_t.x"), F.col("_t.y")))
    rows.drop("_t").repartitionByRange("cell_y", "cell_x", "min_z").sortWithinPartitions("cell_y", "cell_x", "min_z", "quad_key", "id").write.mode("overwrite").parquet(path)


def render(store: DataFrame, tile_set: DataFrame, flags: Flags = Flags(), seaside: DataFrame | None = None) -> DataFrame:
    """Features of each tile as they are drawn: (z, x, y, layer, id, geom_type, parts, meta)."""
    tile_set = tile_set.where(require_tile(F.col("z"), F.col("x"), F.col("y"))).select("z", "x", "y").distinct()
    if seaside is not None and flags.ignore_fully_seaside:
        tile_set = covered(tile_set, seaside, "left_anti")
    rows = spatial.dedup_in_tile(spatial.match(store, tile_set))
    rows = rows.select("z", "x", "y", "layer", "id", "geom_type", "meta", *[f"draw_{c}" for c in spatial.BOX], "parts")
    merged = None
    if flags.aggregate_lines:
        # one box per tile: it rides along with the group's key
        key = ["z", "x", "y", "layer", "meta", *[f"draw_{c}" for c in spatial.BOX]]
        merged = shapes.merge_lines(rows.where(F.col("geom_type") == LINE), *key, simplify=True)
        merged = merged.withColumn("geom_type", F.lit(LINE)).select(*rows.columns)
        rows = rows.where(F.col("geom_type") != LINE).unionByName(merged)
    drawn = shapes.clip_and_shift(rows, flags.drop_subpixel and flags.aggregate_polygons)
    return drawn.select("z", "x", "y", "layer", "id", "geom_type", "meta", "parts")


def debug_features(tile_set: DataFrame) -> DataFrame:
    """Two features per tile in layer tiles_debug_info: its centre, with its name, and its outline."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    corner = lambda dx, dy: F.struct(((x * 4096) + dx).alias("x"), ((y * 4096) + dy).alias("y"))
    center = F.array(F.array(F.array(corner(2048, 2048))))
    outline = F.array(F.array(F.array(*[corner(a, b) for a, b in ((0, 0), (4095, 0), (4095, 4095), (0, 4095), (0, 0))])))
    name = F.array(F.struct(F.lit("tile_id").alias("key"), F.struct(F.lit(2).cast("tinyint").alias("vtype"), F.concat_ws("/", z, x, y).alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("bigint").alias("i")).alias("value")))
    both = F.array(F.struct(F.lit(1).cast("long").alias("id"), F.lit(POINT).alias("geom_type"), name.alias("meta"), center.alias("parts")), F.struct(F.lit(2).cast("long").alias("id"), F.lit(LINE).alias("geom_type"), F.slice(name, 1, 0).alias("meta"), outline.alias("parts")))
    return tile_set.select("z", "x", "y", F.lit("tiles_debug_info").alias("layer"), F.explode(both).alias("f")).select("z", "x", "y", "layer", "f.*")


def get_tiles(store: DataFrame, tile_set: DataFrame, flags: Flags = Flags(), seaside: DataFrame | None = None, prepared: DataFrame | None = None) -> DataFrame:
    """(z, x, y, n_features, mvt) of the squares that have features; prepared squares are looked up."""
    if prepared is not None and not flags.ignore_prepared:
        deepest = prepared.agg(F.coalesce(F.max("z"), F.lit(-1)).alias("z")).first()[0]
        known = tile_set.where(F.col("z") <= deepest).join(prepared, ["z", "x", "y"]).select("z", "x", "y", "n_features", "mvt")
        return known.unionByName(get_tiles(store, tile_set.where(F.col("z") > deepest), flags, seaside))
    rows = render(store, tile_set, flags, seaside)
    if flags.debug:
        rows = rows.unionByName(debug_features(tile_set))
    # layers are numbered by name: the order in the tile is the same wherever it is made
    return encode_tiles(rows.withColumn("layer_idx", F.when(F.col("layer") == "coastline", "").otherwise(F.col("layer"))), flags.compress)


def dataset_bounds(store: DataFrame) -> DataFrame:
    return store.agg(F.min("cell_x").alias("min_x"), F.min("cell_y").alias("min_y"), F.max("cell_x").alias("max_x"), F.max("cell_y").alias("max_y"))


def prepare_tiles(store: DataFrame, deepest: int = 10, shallowest: int = 0, seaside: DataFrame | None = None) -> DataFrame:
    """All squares with features from zoom `shallowest` to `deepest`.

    Which squares to make follows from the stored cells, so empty ones are never listed.
    """
    # what lies beyond the world's edge is in no square
    world = F.col("cell_x").between(0, (1 << CELL_ZOOM) - 1) & F.col("cell_y").between(0, (1 << CELL_ZOOM) - 1)
    cells = store.where(world).select("cell_x", "cell_y", "min_z").groupBy("cell_x", "cell_y").agg(F.min("min_z").alias("min_z"))
    zooms = F.filter(F.sequence(F.lit(shallowest).cast("long"), F.lit(deepest).cast("long")), lambda z: z >= F.col("min_z"))
    tile_set = cells.withColumn("z", F.explode(zooms))
    drop = (CELL_ZOOM - F.col("z")).cast("int")
    tile_set = tile_set.select("z", F.call_function("shiftright", F.col("cell_x"), drop).alias("x"), F.call_function("shiftright", F.col("cell_y"), drop).alias("y")).distinct()
    return get_tiles(store, tile_set, PREPARE, seaside)


def get_tile(spark: SparkSession, store: DataFrame, z: int, x: int, y: int, flags: Flags = Flags()) -> bytes | None:
    """One tile, or None if it is empty."""
    row = get_tiles(store, spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in (("z", z), ("x", x), ("y", y))]), flags).first()
    return None if row is None else bytes(row["mvt"])

