"""Tile arithmetic, projections of coordinates, and joins of features with squares."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.fixtures import sql
from quadloom.functions import geometry as geo
from quadloom.functions import mercator, text
from quadloom.functions import tilemath as tm
from quadloom.operators import spatial
from quadloom.queries import query

c = F.col
BOX = ("min_x", "min_y", "max_x", "max_y")

_INV = "degrees(2 * atan(exp(pi() * (1 - 2 * y / 4294967296.0))) - pi() / 2)"


@query("mercator", """
SELECT id, CAST(greatest(least(floor((lng + 180) / 360 * 4294967296.0), 4294967295), 0) AS BIGINT) AS x,
  CAST(greatest(least(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4294967296.0), 4294967295), 0) AS BIGINT) AS y
FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 36001) / 100.0e0 - 180 AS lng, (c_custkey * 104729 % 17001) / 100.0e0 - 85 AS lat FROM customer)""")
def run_mercator(spark, sf):
    i = c("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(i.alias("id"), (i * 7919 % 36001 / 100.0 - 180).alias("lng"), (i * 104729 % 17001 / 100.0 - 85).alias("lat"))
    return rows.withColumn("p", mercator.latlng_to_fixed(c("lat"), c("lng"))).select("id", "p.x", "p.y")


@query("inv_mercator", sql(f"SELECT id, round({_INV}, 6) AS lat, round(x / 4294967296.0 * 360 - 180, 6) AS lng FROM fx_points", "fx_points"))
def run_inv_mercator(spark, sf):
    p = fx.points(spark, sf).withColumn("p", mercator.fixed_to_latlng(c("x"), c("y")))
    return p.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("tile_key", sql("""SELECT z, x, y, n, (z << 59) | (y << 38) | (x << 17) | n AS key, z AS back_z, x AS back_x, y AS back_y, n AS back_n
  FROM (SELECT z, x, y, (x * 31 + y) % 131072 AS n FROM fx_requests WHERE z <= 15)""", "fx_requests"))
def run_tile_key(spark, sf):
    rows = fx.requests(spark).withColumn("n", (c("x") * 31 + c("y")) % 131072).withColumn("key", tm.tile_to_key(c("z"), c("x"), c("y"), c("n")))
    return rows.withColumn("b", tm.key_to_tile(c("key"))).select("z", "x", "y", "n", "key", *[c(f"b.{k}").alias(f"back_{k}") for k in "zxyn"])


@query("key_order", sql("SELECT z, x, y, row_number() OVER (ORDER BY z, y, x) AS place FROM fx_requests WHERE z <= 9", "fx_requests"))
def run_key_order(spark, sf):
    from pyspark.sql import Window

    rows = fx.requests(spark).where("z <= 9")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(tm.tile_to_key(c("z"), c("x"), c("y"), F.lit(0)))).cast("long"))


_CELLS = "SELECT id, unnest(range(min_x >> 22, (max_x >> 22) + 1)) AS cell_x, min_y, max_y FROM fx_rects"


@query("cell_assign", sql(f"SELECT id, cell_x, unnest(range(min_y >> 22, (max_y >> 22) + 1)) AS cell_y FROM ({_CELLS})", "fx_rects"))
def run_cell_assign(spark, sf):
    return spatial.assign_cells(fx.rects(spark, sf)).select("id", "cell_x", "cell_y")


@query("tile_bounds", sql("""SELECT z, x, y, x << CAST(32 - z AS INT) AS min_x, y << CAST(32 - z AS INT) AS min_y, (x + 1) << CAST(32 - z AS INT) AS max_x, (y + 1) << CAST(32 - z AS INT) AS max_y,
  (x << CAST(32 - z AS INT)) - 4096 AS draw_min_x, (y << CAST(32 - z AS INT)) - 4096 AS draw_min_y, ((x + 1) << CAST(32 - z AS INT)) + 4096 AS draw_max_x, ((y + 1) << CAST(32 - z AS INT)) + 4096 AS draw_max_y FROM fx_requests""", "fx_requests"))
def run_tile_bounds(spark, sf):
    return spatial.with_bounds(fx.requests(spark))


@query("tile_parent", sql("SELECT z, x, y, z - 1 AS pz, x >> 1 AS px, y >> 1 AS py, (y & 1) * 2 + (x & 1) AS quad_pos FROM fx_requests", "fx_requests"))
def run_tile_parent(spark, sf):
    p = fx.requests(spark).withColumn("p", tm.parent(c("z"), c("x"), c("y")))
    return p.select("z", "x", "y", *[c(f"p.{k}").alias(f"p{k}") for k in "zxy"], tm.quad_pos(c("x"), c("y")).alias("quad_pos"))


@query("tile_children", sql("SELECT z, x, y, z + 1 AS cz, x * 2 + k % 2 AS cx, y * 2 + k // 2 AS cy FROM (SELECT *, unnest(range(CAST(0 AS BIGINT), CAST(4 AS BIGINT))) AS k FROM fx_requests)", "fx_requests"))
def run_tile_children(spark, sf):
    rows = fx.requests(spark).withColumn("k", F.explode(tm.children(c("z"), c("x"), c("y"))))
    return rows.select("z", "x", "y", *[c(f"k.{k}").alias(f"c{k}") for k in "zxy"])


@query("tile_valid", """SELECT event_id, z, x, y, z BETWEEN 0 AND 20 AND x < (CAST(1 AS BIGINT) << CAST(least(z, 20) AS INT)) AND y < (CAST(1 AS BIGINT) << CAST(least(z, 20) AS INT)) AS valid
  FROM (SELECT event_id, event_id % 24 AS z, event_id * 37 % 5000 AS x, user_id % 5000 AS y FROM events)""")
def run_tile_valid(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (c("event_id") % 24).alias("z"), (c("event_id") * 37 % 5000).alias("x"), (c("user_id") % 5000).alias("y"))
    return e.withColumn("valid", tm.tile_exists(c("z"), c("x"), c("y")))


def _fold(axis: str) -> str:
    return f"CASE WHEN max_{axis} < ((t{axis} * 2 + 1) << CAST(31 - tz AS INT)) THEN 0 WHEN min_{axis} > ((t{axis} * 2 + 1) << CAST(31 - tz AS INT)) THEN 1 ELSE -1 END"


_BEST = f"""
b AS (SELECT id, min_x, min_y, max_x, max_y, CAST(10 AS BIGINT) AS tz, cell_x AS tx, unnest(range(min_y >> 22, (max_y >> 22) + 1)) AS ty, cell_x, FALSE AS done
      FROM (SELECT *, unnest(range(min_x >> 22, (max_x >> 22) + 1)) AS cell_x FROM fx_rects)),
w AS (SELECT id, min_x, min_y, max_x, max_y, tz, tx, ty, cell_x, ty AS cell_y, done FROM b
      UNION ALL
      SELECT id, min_x, min_y, max_x, max_y, tz + 1, tx * 2 + sx, ty * 2 + sy, cell_x, cell_y, done
      FROM (SELECT *, CAST({_fold("x")} AS BIGINT) AS sx, CAST({_fold("y")} AS BIGINT) AS sy FROM w) WHERE tz < 20 AND sx >= 0 AND sy >= 0),
best AS (SELECT id, cell_x, cell_y, max(tz) AS z, max_by(tx, tz) AS x, max_by(ty, tz) AS y FROM w GROUP BY ALL)"""


def best_sql(body: str) -> str:
    return f"WITH RECURSIVE fx_rects AS ({fx.SQL['fx_rects']}), {_BEST}\n{body}"


@query("best_tile", best_sql("SELECT id, cell_x, cell_y, z, x, y FROM best"))
def run_best_tile(spark, sf):
    rows = spatial.assign_cells(fx.rects(spark, sf)).withColumn("t", tm.best_tile(c("cell_x"), c("cell_y"), *map(c, BOX)))
    return rows.select("id", "cell_x", "cell_y", "t.z", "t.x", "t.y")


@query("quad_key", best_sql("""SELECT id, cell_x, cell_y, z, coalesce((SELECT string_agg(CAST(((y >> CAST(z - a AS INT)) & 1) * 2 + ((x >> CAST(z - a AS INT)) & 1) AS VARCHAR), '' ORDER BY a)
  FROM (SELECT unnest(range(11, z + 1)) AS a)), '') AS quad_key FROM best"""))
def run_quad_key(spark, sf):
    return run_best_tile(spark, sf).select("id", "cell_x", "cell_y", "z", tm.quad_key(c("z"), c("x"), c("y")).alias("quad_key"))


_URLS = "SELECT z, x, y, CASE (z + x + y) % 5 WHEN 0 THEN '/' || z || '/' || x || '/' || y || '.mvt' WHEN 1 THEN '/t/' || z || '/' || x || '/' || y || '.mvt' WHEN 2 THEN '/' || z || '/' || x || '/' || y || 'xmvt' WHEN 3 THEN '/' || z || '/' || x || '/' || y || '.mvtx' ELSE '/' || z || '/' || x || '.mvt' END AS url FROM fx_requests"


def _urls(spark):
    z, x, y = c("z"), c("x"), c("y")
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = (z + x + y) % 5
    url = F.when(k == 0, path("/", z, "/", x, "/", y, ".mvt")).when(k == 1, path("/t/", z, "/", x, "/", y, ".mvt")).when(k == 2, path("/", z, "/", x, "/", y, "xmvt")).when(k == 3, path("/", z, "/", x, "/", y, ".mvtx")).otherwise(path("/", z, "/", x, ".mvt"))
    return fx.requests(spark).withColumn("url", url)


def _parsed(pattern: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(url, '{pattern}') THEN TRY_CAST(regexp_extract(url, '{pattern}', {i + 1}) AS BIGINT) END AS u{k}" for i, k in enumerate("zxy"))


@query("parse_url", sql(f"SELECT url, {_parsed(text.SERVER_URL)} FROM ({_URLS}) UNION ALL SELECT url, {_parsed(text.SERVER_URL)} FROM pages", "fx_requests"))
def run_parse_url(spark, sf):
    urls = _urls(spark).select("url").union(spark.read.parquet(f"{sf}/pages.parquet").select("url"))
    return urls.withColumn("t", text.parse_tile_url(c("url"))).select("url", *[c(f"t.{k}").alias(f"u{k}") for k in "zxy"])


@query("http_status", sql(f"""SELECT url, method, deflate, size, CAST(CASE WHEN method = 'OPTIONS' THEN 204 WHEN method NOT IN ('GET', 'HEAD') THEN 405 WHEN NOT regexp_matches(url, '{text.SERVER_URL}') THEN 404 WHEN NOT deflate THEN 501 WHEN size = 0 THEN 204 ELSE 200 END AS INTEGER) AS status
  FROM (SELECT url, CASE x % 4 WHEN 0 THEN 'OPTIONS' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'GET' ELSE 'POST' END AS method, y % 3 <> 0 AS deflate, x * y % 7 AS size FROM ({_URLS}))""", "fx_requests"))
def run_http_status(spark, sf):
    x, y = c("x"), c("y")
    rows = _urls(spark).select("url", F.when(x % 4 == 0, "OPTIONS").when(x % 4 == 1, "HEAD").when(x % 4 == 2, "GET").otherwise("POST").alias("method"), (y % 3 != 0).alias("deflate"), (x * y % 7).alias("size"))
    return rows.withColumn("status", text.http_status(c("method"), c("url"), c("deflate"), c("size")))


@query("url_decode")
def run_url_decode(spark, sf):
    u = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return u.select("page_id", text.url_decode(F.concat(F.url_encode("url"), F.when(c("page_id") % 5 == 0, F.lit("%2")).otherwise(F.lit("")))).alias("decoded"))


@query("tile_cells", sql("""SELECT z, x, y, cell_x, unnest(range(CASE WHEN z >= 10 THEN y >> CAST(greatest(z - 10, 0) AS INT) ELSE y << CAST(greatest(10 - z, 0) AS INT) END, CASE WHEN z >= 10 THEN (y >> CAST(greatest(z - 10, 0) AS INT)) + 1 ELSE (y + 1) << CAST(greatest(10 - z, 0) AS INT) END)) AS cell_y
  FROM (SELECT z, x, y, unnest(range(CASE WHEN z >= 10 THEN x >> CAST(greatest(z - 10, 0) AS INT) ELSE x << CAST(greatest(10 - z, 0) AS INT) END, CASE WHEN z >= 10 THEN (x >> CAST(greatest(z - 10, 0) AS INT)) + 1 ELSE (x + 1) << CAST(greatest(10 - z, 0) AS INT) END)) AS cell_x FROM fx_requests)""", "fx_requests"))
def run_tile_cells(spark, sf):
    return spatial.tile_cells(fx.requests(spark))


def rect_store(spark, sf):
    """Rectangles as stored features: lowest zoom 8 to 11 by id, highest 21."""
    rows = fx.rects(spark, sf).withColumns({"layer": F.concat(F.lit("l"), c("id") % 3), "geom_type": F.lit(3), "min_z": (8 + c("id") % 4).cast("int"), "max_z": F.lit(21)})
    return spatial.assign_cells(rows)


_MATCH = """m AS (SELECT r.z, r.x, r.y, f.id, f.id % 3 AS layer FROM fx_requests r JOIN fx_rects f
  ON 8 + f.id % 4 <= r.z AND f.min_x <= ((r.x + 1) << CAST(32 - r.z AS INT)) + 4096 AND f.max_x >= (r.x << CAST(32 - r.z AS INT)) - 4096
  AND f.min_y <= ((r.y + 1) << CAST(32 - r.z AS INT)) + 4096 AND f.max_y >= (r.y << CAST(32 - r.z AS INT)) - 4096
  AND (f.min_x >> 22) <= (CASE WHEN r.z >= 10 THEN r.x >> CAST(greatest(r.z - 10, 0) AS INT) ELSE ((r.x + 1) << CAST(greatest(10 - r.z, 0) AS INT)) - 1 END)
  AND (f.max_x >> 22) >= (CASE WHEN r.z >= 10 THEN r.x >> CAST(greatest(r.z - 10, 0) AS INT) ELSE r.x << CAST(greatest(10 - r.z, 0) AS INT) END)
  AND (f.min_y >> 22) <= (CASE WHEN r.z >= 10 THEN r.y >> CAST(greatest(r.z - 10, 0) AS INT) ELSE ((r.y + 1) << CAST(greatest(10 - r.z, 0) AS INT)) - 1 END)
  AND (f.max_y >> 22) >= (CASE WHEN r.z >= 10 THEN r.y >> CAST(greatest(r.z - 10, 0) AS INT) ELSE r.y << CAST(greatest(10 - r.z, 0) AS INT) END))"""


def match_sql(body: str) -> str:
    return f"WITH fx_rects AS ({fx.SQL['fx_rects']}), fx_requests AS ({fx.SQL['fx_requests']}), {_MATCH}\n{body}"


@query("spatial_join", match_sql("SELECT z, x, y, id FROM m"))
def run_spatial_join(spark, sf):
    return spatial.match(rect_store(spark, sf), fx.requests(spark)).select("z", "x", "y", "id").distinct()


@query("tile_dedup", match_sql("SELECT z, x, y, 'l' || layer AS layer, count(*) AS n FROM m GROUP BY ALL"))
def run_tile_dedup(spark, sf):
    rows = spatial.dedup_in_tile(spatial.match(rect_store(spark, sf), fx.requests(spark)))
    return rows.groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n"))


_SCAN = "SELECT id, cell_x, cell_y FROM (SELECT id, cell_x, unnest(range(min_y >> 22, (max_y >> 22) + 1)) AS cell_y FROM (" + _CELLS + ")) WHERE cell_x BETWEEN 536 AND 539 AND cell_y BETWEEN 344 AND 347"


@query("range_scan", sql(_SCAN, "fx_rects"))
def run_range_scan(spark, sf):
    return spatial.range_scan(rect_store(spark, sf), (8, 134, 86)).select("id", "cell_x", "cell_y")


@query("scan_indexed", sql(f"SELECT DISTINCT s.id FROM ({_SCAN}) s JOIN fx_rects f ON s.id = f.id WHERE 8 + f.id % 4 <= 9 AND f.min_x <= (CAST(269 AS BIGINT) << 23) + 4096 AND f.max_x >= (CAST(268 AS BIGINT) << 23) - 4096 AND f.min_y <= (CAST(174 AS BIGINT) << 23) + 4096 AND f.max_y >= (CAST(173 AS BIGINT) << 23) - 4096 AND cell_x BETWEEN 536 AND 537 AND cell_y BETWEEN 346 AND 347", "fx_rects"))
def run_scan_indexed(spark, sf):
    tile = spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in (("z", 9), ("x", 268), ("y", 173))])
    return spatial.match(rect_store(spark, sf), tile).select("id").distinct()


@query("pack_order", best_sql("""SELECT id, cell_x, cell_y, min_z, place FROM (SELECT id, cell_x, cell_y, 8 + id % 4 AS min_z, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY 8 + id % 4, coalesce((SELECT string_agg(CAST(((y >> CAST(z - a AS INT)) & 1) * 2 + ((x >> CAST(z - a AS INT)) & 1) AS VARCHAR), '' ORDER BY a)
  FROM (SELECT unnest(range(11, z + 1)) AS a)), ''), id) AS place FROM best)"""))
def run_pack_order(spark, sf):
    from pyspark.sql import Window

    t = tm.best_tile(c("cell_x"), c("cell_y"), *map(c, BOX))
    rows = spatial.assign_cells(fx.rects(spark, sf)).withColumn("t", t).withColumn("min_z", 8 + c("id") % 4)
    w = Window.partitionBy("cell_x", "cell_y").orderBy("min_z", tm.quad_key(c("t.z"), c("t.x"), c("t.y")), "id")
    return rows.select("id", "cell_x", "cell_y", "min_z", F.row_number().over(w).cast("long").alias("place"))


@query("clip_point", sql("SELECT id FROM fx_points WHERE x > 2250000000 AND x < 2300000000 AND y > 1450000000 AND y < 1500000000", "fx_points"))
def run_clip_point(spark, sf):
    return fx.points(spark, sf).where(geo.in_box(c("x"), c("y"), *[F.lit(v) for v in (2250000000, 1450000000, 2300000000, 1500000000)])).select("id")
