"""What the bundled map styles ask of the layers."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.fixtures import sql
from quadloom.functions.tags import tag_integer
from quadloom.operators import style
from quadloom.queries import query

c = F.col
_POP = "CAST(TRY_CAST(nullif(regexp_extract(population, '^-?[0-9]+'), '') AS BIGINT) AS DOUBLE)"


def _cities(spark, sf):
    return fx.points(spark, sf).select("id", "place", tag_integer(c("population")).alias("population"))


@query("style_filter", sql(f"SELECT id, z FROM (SELECT id, place, {_POP} AS population FROM fx_points), (VALUES (CAST(8 AS INTEGER)), (12)) v(z) WHERE place NOT IN ('hamlet') AND (z > 10 OR coalesce(population, 0) > 10000)", "fx_points"))
def run_style_filter(spark, sf):
    rows = _cities(spark, sf).where(style.not_in(c("place"), "hamlet"))
    return style.shown_cities(rows, 8).select("id", F.lit(8).alias("z")).union(style.shown_cities(rows, 12).select("id", F.lit(12).alias("z")))


@query("style_has", sql("SELECT id, population IS NOT NULL AND place = 'city' AS both_, population IS NOT NULL OR place = 'city' AS either_ FROM fx_points", "fx_points"))
def run_style_has(spark, sf):
    p = fx.points(spark, sf)
    has, city = c("population").isNotNull(), c("place") == "city"
    return p.select("id", (has & city).alias("both_"), (has | city).alias("either_"))


def _width(z: str) -> str:
    out = f"{style.WIDTH_STOPS[-1][1]}e0"
    for (z0, v0), (z1, v1) in reversed(list(zip(style.WIDTH_STOPS, style.WIDTH_STOPS[1:]))):
        out = f"CASE WHEN {z} < {z1} THEN {v0}e0 + ({z} - {z0}) * {(v1 - v0) / (z1 - z0)}e0 ELSE {out} END"
    return f"CASE WHEN {z} < {style.WIDTH_STOPS[0][0]} THEN {style.WIDTH_STOPS[0][1]}e0 ELSE {out} END"


@query("style_width", sql(f"SELECT id, z, CASE kind WHEN 'F' THEN 1.0e0 WHEN 'O' THEN 0.75e0 ELSE 0.25e0 END * ({_width('z')}) AS width FROM (SELECT id, kind, id % 24 AS z FROM fx_segments)", "fx_segments"))
def run_style_width(spark, sf):
    road = F.when(c("kind") == "F", "motorway").when(c("kind") == "O", "primary").otherwise("residential")
    return fx.segments(spark, sf).select("id", (c("id") % 24).alias("z"), style.road_width(road, c("id") % 24).alias("width"))


@query("style_sort", sql(f"SELECT id, row_number() OVER (ORDER BY coalesce({_POP}, 0) DESC, id) AS place FROM fx_points", "fx_points"))
def run_style_sort(spark, sf):
    rows = _cities(spark, sf)
    return rows.select("id", style.symbol_order(rows).cast("long").alias("place"))


@query("style_match", sql("SELECT id, CASE kind WHEN 'STANDARD' THEN 'red' ELSE CASE WHEN w > 1000000 THEN 'green' ELSE 'blue' END END AS color FROM (SELECT id, w, CASE WHEN id % 2 = 0 THEN 'STANDARD' ELSE kind END AS kind FROM fx_rects)", "fx_rects"))
def run_style_match(spark, sf):
    kind = F.when(c("id") % 2 == 0, "STANDARD").otherwise(c("kind"))
    return fx.rects(spark, sf).select("id", F.when(kind == "STANDARD", "red").otherwise(F.when(c("w") > 1000000, "green").otherwise("blue")).alias("color"))
