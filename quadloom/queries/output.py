"""Encodings and squares: commands, debug layer, vector map squares, compression, codecs."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.fixtures import sql
from quadloom.functions import geometry as geo
from quadloom.operators import mvt, shapes, spatial
from quadloom.plans import render
from quadloom.queries import query
from quadloom.queries.geometry import rect_parts
from quadloom.sources import shared_folder

c = F.col


@query("zigzag", sql("SELECT way_id, pos, CASE WHEN ref >= 0 THEN 2 * ref ELSE -2 * ref - 1 END AS z FROM fx_way_nodes", "fx_way_nodes"))
def run_zigzag(spark, sf):
    return fx.way_nodes(spark, sf).select("way_id", "pos", geo.zigzag(c("ref")).alias("z"))


@query("mvt_cmd", sql("SELECT way_id, pos, (way_id % 8 & 7) | (pos << 3) AS cmd FROM fx_way_nodes", "fx_way_nodes"))
def run_mvt_cmd(spark, sf):
    return fx.way_nodes(spark, sf).select("way_id", "pos", geo.command(c("way_id") % 8, c("pos")).alias("cmd"))


_ZZ = "CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END".format


@query("mvt_cmd_count", sql(f"SELECT id, CAST(9 AS BIGINT) AS c0, {_ZZ('from_x')} AS c1, {_ZZ('from_y')} AS c2, CAST(10 AS BIGINT) AS c3, {_ZZ('to_x - from_x')} AS c4, {_ZZ('to_y - from_y')} AS c5, CAST(6 AS INTEGER) AS n FROM fx_segments", "fx_segments"))
def run_mvt_cmd_count(spark, sf):
    """The commands of each line: one MOVE_TO, then one LINE_TO, with zig-zag steps."""
    s = fx.segments(spark, sf)
    s = s.withColumn("cmd", mvt.line_commands(F.array(geo.xy(c("from_x"), c("from_y")), geo.xy(c("to_x"), c("to_y")))))
    return s.select("id", *[F.get("cmd", F.lit(k)).alias(f"c{k}") for k in range(6)], F.size("cmd").alias("n"))


@query("debug_layer", sql("SELECT z, x, y, 1 AS id, CAST(1 AS INTEGER) AS n_points, x * 4096 + 2048 AS px, y * 4096 + 2048 AS py FROM fx_requests UNION ALL SELECT z, x, y, 2, 5, x * 4096, y * 4096 FROM fx_requests", "fx_requests").replace("1 AS id", "CAST(1 AS BIGINT) AS id"))
def run_debug_layer(spark, sf):
    p = c("parts")[0][0]
    return render.debug_features(fx.requests(spark)).select("z", "x", "y", "id", F.size(p).alias("n_points"), p[0]["x"].alias("px"), p[0]["y"].alias("py"))


def store(spark, sf):
    """The store, written once: rules are applied once, and readers skip by cell and zoom."""
    path = f"{shared_folder(spark, 'store')}/features"
    render.write_store(render.import_features(fx.features(spark, sf)), path)
    return spark.read.parquet(path)


@query("mvt_encode")
def run_mvt_encode(spark, sf):
    tile_set = render.get_tiles(store(spark, sf), fx.requests(spark))
    return tile_set.select("z", "x", "y", "n_features", F.length("mvt").alias("bytes"), F.crc32("mvt").alias("crc"))


@query("prepare_tiles")
def run_prepare_tiles(spark, sf):
    tile_set = render.prepare_tiles(store(spark, sf), 10, 0, fx.seaside(spark, sf).where("z >= 9"))
    return tile_set.select("z", "x", "y", "n_features", F.length("mvt").alias("bytes"))


@query("deflate")
def run_deflate(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.length(shapes.deflate(F.encode("text", "utf-8"))).alias("bytes"))


@query("crc")
def run_crc(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


def _bytes(v: str) -> str:
    z = f"(CASE WHEN {v} >= 0 THEN 2 * ({v}) ELSE -2 * ({v}) - 1 END)"
    return "(1 + " + " + ".join(f"CASE WHEN {z} >= {1 << 7 * k} THEN 1 ELSE 0 END" for k in range(1, 6)) + ")"


@query("feature_codec", sql("SELECT id, CAST(" + " + ".join(map(_bytes, ("min_x - 2147483648", "min_y - 2147483648", "w", "-w", "h", "-h"))) + " + 4 AS INTEGER) AS bytes, TRUE AS same FROM fx_rects", "fx_rects"))
def run_feature_codec(spark, sf):
    rows = fx.rects(spark, sf).select("id", F.flatten(F.flatten(rect_parts())).alias("points")).withColumn("code", shapes.encode_line(c("points")))
    return rows.select("id", F.length("code").alias("bytes"), (shapes.decode_line(c("code")) == c("points")).alias("same"))


@query("union_sources", sql("""SELECT z, x, y, 'seaside' AS source, count(*) AS n FROM fx_seaside GROUP BY ALL
  UNION ALL SELECT CAST(10 AS BIGINT), cell_x, unnest(range(a, b)) AS y, 'pack', 1 FROM (SELECT 0 AS cell_x, 0 AS a, 0 AS b) WHERE FALSE
  UNION ALL SELECT 10, x >> 22, y >> 22, 'pack', count(*) FROM fx_points GROUP BY ALL""".replace("  UNION ALL SELECT CAST(10 AS BIGINT), cell_x, unnest(range(a, b)) AS y, 'pack', 1 FROM (SELECT 0 AS cell_x, 0 AS a, 0 AS b) WHERE FALSE\n", "").replace("SELECT 10, x >> 22", "SELECT CAST(10 AS BIGINT), x >> 22"), "fx_seaside", "fx_points"))
def run_union_sources(spark, sf):
    sea = fx.seaside(spark, sf).withColumn("source", F.lit("seaside"))
    cell = spatial.cell_of(c("x"), c("y"))
    packs = fx.points(spark, sf).select(F.lit(10).cast("long").alias("z"), cell[0].alias("x"), cell[1].alias("y"), F.lit("pack").alias("source"))
    return sea.unionByName(packs).groupBy("z", "x", "y", "source").agg(F.count(F.lit(1)).alias("n"))


