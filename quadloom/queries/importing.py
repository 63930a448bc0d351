"""OSM assembly and file sources."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.fixtures import sql
from quadloom.operators import shapes, tables
from quadloom.queries import query
from quadloom.sources import osm_pbf, shapefile, shared_folder, write_parts

c = F.col


@query("way_nodes", sql("SELECT w.way_id, w.pos, w.ref, n.x, n.y FROM fx_way_nodes w LEFT JOIN fx_nodes n ON abs(w.ref) = abs(n.node_id)", "fx_way_nodes", "fx_nodes"))
def run_way_nodes(spark, sf):
    return tables.locate_way_nodes(fx.way_nodes(spark, sf), fx.nodes(spark, sf))


@query("way_geometry", sql("SELECT way_id, CAST(count(*) AS INTEGER) AS n_points, min(n.x) AS min_x, max(n.y) AS max_y FROM fx_way_nodes w JOIN fx_nodes n ON abs(w.ref) = abs(n.node_id) GROUP BY way_id HAVING count(*) >= 2", "fx_way_nodes", "fx_nodes"))
def run_way_geometry(spark, sf):
    lines = tables.way_lines(tables.locate_way_nodes(fx.way_nodes(spark, sf), fx.nodes(spark, sf)))
    return lines.select("way_id", F.size("points").alias("n_points"), F.array_min(F.transform("points", lambda p: p["x"])).alias("min_x"), F.array_max(F.transform("points", lambda p: p["y"])).alias("max_y"))


@query("multipolygon", sql("SELECT id AS relation_id, CAST(1 AS BIGINT) AS n_parts, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_rings FROM fx_rects", "fx_rects"))
def run_multipolygon(spark, sf):
    """Each rectangle as a relation of two open ways, and a hole in every third."""
    r = fx.rects(spark, sf)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (c(k) for k in ("min_x", "min_y", "max_x", "max_y"))
    i, j, k, m = x0 + F.expr("w div 4"), y0 + F.expr("h div 4"), x0 + F.expr("w div 2"), y0 + F.expr("h div 2")
    ways = F.array(
        F.struct((c("id") * 3).alias("way_id"), F.lit("outer").alias("role"), F.array(p(x0, y0), p(x1, y0), p(x1, y1)).alias("points")),
        F.struct((c("id") * 3 + 1).alias("way_id"), F.lit("outer").alias("role"), F.array(p(x0, y0), p(x0, y1), p(x1, y1)).alias("points")),
        F.struct((c("id") * 3 + 2).alias("way_id"), F.lit("inner").alias("role"), F.when(c("id") % 3 == 0, F.array(p(i, j), p(k, j), p(k, m), p(i, m), p(i, j))).alias("points")),
    )
    rows = r.select(c("id").alias("relation_id"), F.explode(ways).alias("w")).select("relation_id", "w.*").where("points is not null")
    out = shapes.multipolygons(rows.select("relation_id", "way_id", "role"), rows.select("way_id", "points"))
    return out.select("relation_id", "n_parts", F.size(c("parts")[0]).alias("n_rings"))


_OSM = """SELECT 'node' AS kind, node_id AS id, y % 1700000000 - 850000000 AS lat_e7, x % 3600000000 - 1800000000 AS lng_e7, CAST(CASE WHEN node_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_tags, CAST(NULL AS INTEGER) AS n_refs, CAST(NULL AS BIGINT) AS sum_refs FROM fx_nodes
UNION ALL SELECT 'way', 100000000 + way_id, NULL, NULL, CAST(1 AS INTEGER), CAST(count(*) AS INTEGER), CAST(sum(ref) AS BIGINT) FROM fx_way_nodes GROUP BY way_id"""


@query("scan_osm", sql(_OSM.replace("100000000 +", "CAST(100000000 AS BIGINT) +"), "fx_nodes", "fx_way_nodes"))
def run_scan_osm(spark, sf):
    """All derived nodes and ways, written as PBF files by the executors and scanned."""
    text = F.expr("cast(map() as map<string,string>)")
    none = [F.lit(None).cast(t) for t in ("double", "double", "array<bigint>")]
    n = fx.nodes(spark, sf).select(F.lit("node").alias("kind"), "node_id", ((c("y") % 1700000000 - 850000000) / 1e7).alias("lat"), ((c("x") % 3600000000 - 1800000000) / 1e7).alias("lng"), F.when(c("node_id") % 5 == 0, F.create_map(F.lit("place"), F.lit("city"))).otherwise(text).alias("tags"), none[2].alias("refs"))
    w = fx.way_nodes(spark, sf).groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda p: p["ref"]).alias("refs"))
    w = w.select(F.lit("way"), c("way_id") + 100000000, none[0], none[1], F.create_map(F.lit("highway"), F.lit("trunk")), "refs")
    folder = shared_folder(spark, "extract")
    write_parts(n.union(w), folder, ".osm.pbf", lambda path, rows: osm_pbf.write(path, ((*r[:4], dict(r[4]), r[5], None) for r in rows)))
    spark.dataSource.register(osm_pbf.OsmPbfSource)
    scan = spark.read.format("osm_pbf").option("path", folder).load()
    e7 = lambda k: F.round(c(k) * 1e7).cast("long").alias(f"{k}_e7")
    return scan.select("kind", "id", e7("lat"), e7("lng"), F.size("tags").alias("n_tags"), F.size("refs").alias("n_refs"), F.aggregate("refs", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_refs"))


@query("scan_shp", sql(f"SELECT min_x - {fx.X0} AS min_x, min_y - {fx.Y0} AS min_y, max_x - {fx.X0} AS max_x, max_y - {fx.Y0} AS max_y, CAST(1 AS INTEGER) AS n_rings, CAST(5 AS INTEGER) AS n_points FROM fx_rects", "fx_rects"))
def run_scan_shp(spark, sf):
    """All derived rectangles, written as zipped shapefiles by the executors and scanned."""
    x0, y0, x1, y1 = ((c(k) - o) / 1e7 for k, o in (("min_x", fx.X0), ("min_y", fx.Y0), ("max_x", fx.X0), ("max_y", fx.Y0)))
    folder = shared_folder(spark, "extract")
    rows = fx.rects(spark, sf).select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    write_parts(rows, folder, ".zip", lambda path, held: shapefile.write(path, ([[(a, b), (a, d), (e, d), (e, b), (a, b)]] for a, b, e, d in held)), part_rows=20_000)
    ring = shapefile.read(spark, f"{folder}/*.zip").select("rings", F.transform(c("rings")[0], lambda p: F.struct(F.round(p["lng"] * 1e7).cast("long").alias("x"), F.round(p["lat"] * 1e7).cast("long").alias("y"))).alias("p"))
    ends = [f(F.transform("p", lambda q: q[k])).alias(n) for n, f, k in (("min_x", F.array_min, "x"), ("min_y", F.array_min, "y"), ("max_x", F.array_max, "x"), ("max_y", F.array_max, "y"))]  # noqa: B023
    return ring.select(*ends, F.size("rings").alias("n_rings"), F.size("p").alias("n_points"))
