"""Derived features over the driver's tables, in Spark and as SQL for the checks.

X0, Y0 is the corner of a block of 16 by 16 storage cells, W its side in pixels at zoom 20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions.geometry import box_ring, xy
from quadloom.functions.tilemath import pixel_to_tile

X0, Y0, W = 2248146944, 1447034880, 67108864

L = "CAST({} AS BIGINT)".format
_XY = f"{L(X0)} + ({{0}} * {L(2654435761)}) % {L(W)}", f"{L(Y0)} + ({{0}} * {L(320733957)}) % {L(W)}"

SQL = {
    "fx_points": f"""SELECT c_custkey AS id, {_XY[0].format("c_custkey")} AS x, {_XY[1].format("c_custkey")} AS y,
      CASE c_custkey % 6 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'borough' WHEN 3 THEN 'suburb' WHEN 4 THEN 'village' ELSE 'hamlet' END AS place,
      c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_custkey * 97 % 100000 AS VARCHAR) END AS population FROM customer""",
    "fx_rects": f"""SELECT id, min_x, min_y, min_x + w AS max_x, min_y + h AS max_y, w, h, kind FROM (
      SELECT p_partkey AS id, {_XY[0].format("p_partkey")} AS min_x, {_XY[1].format("p_partkey")} AS min_y,
      CAST(p_size AS BIGINT) * p_size * 1000 AS w, CAST(p_size AS BIGINT) * 4000 AS h, p_type AS kind FROM part)""",
    "fx_segments": f"""SELECT id, kind, CASE WHEN id % 3 = 0 THEN bx ELSE ax END AS from_x, y AS from_y, CASE WHEN id % 3 = 0 THEN ax ELSE bx END AS to_x, y AS to_y FROM (
      SELECT o_orderkey AS id, o_orderstatus AS kind, {L(X0)} + (o_orderkey >> 3) * 20011 + (o_orderkey & 7) * 4096 AS ax,
      {L(X0)} + (o_orderkey >> 3) * 20011 + ((o_orderkey & 7) + 1) * 4096 AS bx, {L(Y0)} + (o_orderkey >> 3) * 10007 AS y FROM orders)""",
    "fx_nodes": f"""SELECT event_id + (event_id >> 3) * 2 AS node_id, {_XY[0].format("event_id")} AS x, {_XY[1].format("event_id")} AS y FROM events""",
    "fx_way_nodes": """SELECT way_id, pos, CASE WHEN pos % 4 = 3 THEN -r ELSE r END AS ref FROM (
      SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
      (l_partkey * 5 + l_suppkey) % 13000 AS r FROM lineitem)""",
    "fx_seaside": f"""SELECT DISTINCT z, (({L(X0)} + s * 3000017 % {L(W)}) >> CAST(32 - z AS INT)) AS x, (({L(Y0)} + s * 7000003 % {L(W)}) >> CAST(32 - z AS INT)) AS y
      FROM (SELECT s_suppkey AS s, 5 + s_suppkey % 6 AS z FROM supplier)""",
    "fx_events_kv": "SELECT event_id, event_type AS key, props AS value FROM events",
    "fx_requests": f"""SELECT z, x, unnest(range((({L(Y0)}) >> CAST(32 - z AS INT)) - 1, (({L(Y0 + W - 1)}) >> CAST(32 - z AS INT)) + 2)) AS y FROM (
      SELECT z, unnest(range((({L(X0)}) >> CAST(32 - z AS INT)) - 1, (({L(X0 + W - 1)}) >> CAST(32 - z AS INT)) + 2)) AS x
      FROM (SELECT unnest(range(CAST(8 AS BIGINT), CAST(13 AS BIGINT))) AS z))""",
}


def sql(body: str, *names: str) -> str:
    """body with the fixtures it reads defined before it."""
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body) if names else body


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _place(i: Column) -> tuple[Column, Column]:
    return F.lit(X0) + (i * F.lit(2654435761)) % F.lit(W), F.lit(Y0) + (i * F.lit(320733957)) % F.lit(W)


def points(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    x, y = _place(i)
    names = F.array(*map(F.lit, ("city", "town", "borough", "suburb", "village", "hamlet")))
    population = F.when(i % 7 == 0, None).when(i % 11 == 0, "n/a").otherwise((i * 97 % 100000).cast("string"))
    return _table(spark, sf, "customer").select(i.alias("id"), x.alias("x"), y.alias("y"), F.element_at(names, (i % 6 + 1).cast("int")).alias("place"), F.col("c_name").alias("name"), population.alias("population"))


def rects(spark: SparkSession, sf: str) -> DataFrame:
    i, s = F.col("p_partkey"), F.col("p_size").cast("long")
    x, y = _place(i)
    out = _table(spark, sf, "part").select(i.alias("id"), x.alias("min_x"), y.alias("min_y"), (s * s * 1000).alias("w"), (s * 4000).alias("h"), F.col("p_type").alias("kind"))
    return out.select("id", "min_x", "min_y", (F.col("min_x") + F.col("w")).alias("max_x"), (F.col("min_y") + F.col("h")).alias("max_y"), "w", "h", "kind")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    row, col = F.call_function("shiftright", i, F.lit(3)), i.bitwiseAND(F.lit(7).cast("long"))
    a, b = F.lit(X0) + row * 20011 + col * 4096, F.lit(X0) + row * 20011 + (col + 1) * 4096
    y, swap = F.lit(Y0) + row * 10007, i % 3 == 0
    return _table(spark, sf, "orders").select(i.alias("id"), F.col("o_orderstatus").alias("kind"), F.when(swap, b).otherwise(a).alias("from_x"), y.alias("from_y"), F.when(swap, a).otherwise(b).alias("to_x"), y.alias("to_y"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    x, y = _place(i)
    return _table(spark, sf, "events").select((i + F.call_function("shiftright", i, F.lit(3)) * 2).alias("node_id"), x.alias("x"), y.alias("y"))


def way_nodes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    pos = (F.row_number().over(w) - 1).cast("long")
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id"), pos.alias("pos"), ((F.col("l_partkey") * 5 + F.col("l_suppkey")) % 13000).alias("r"))
    return rows.select("way_id", "pos", F.when(F.col("pos") % 4 == 3, -F.col("r")).otherwise(F.col("r")).alias("ref"))


def seaside(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    z = 5 + s % 6
    return _table(spark, sf, "supplier").select(z.alias("z"), pixel_to_tile(F.lit(X0) + s * 3000017 % W, z).alias("x"), pixel_to_tile(F.lit(Y0) + s * 7000003 % W, z).alias("y")).distinct()


def events_kv(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), F.col("props").alias("value"))


def requests(spark: SparkSession, sf: str = "", zooms: tuple[int, int] = (8, 12)) -> DataFrame:
    """Tiles of the block and one cell around it."""
    z = F.col("z")
    span = lambda lo: F.sequence(pixel_to_tile(F.lit(lo), z) - 1, pixel_to_tile(F.lit(lo + W - 1), z) + 1)
    return spark.range(zooms[0], zooms[1] + 1).select(F.col("id").alias("z")).withColumn("x", F.explode(span(X0))).withColumn("y", F.explode(span(Y0)))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Points, lines and polygons with tags: (id, kind of geometry, parts, tags, area), as an importer gets them."""
    p = points(spark, sf)
    p = p.select("id", F.lit(1).alias("geom_type"), F.array(F.array(F.array(xy(F.col("x"), F.col("y"))))).alias("parts"), F.map_filter(F.create_map(F.lit("place"), F.col("place"), F.lit("name"), F.col("name"), F.lit("population"), F.col("population")), lambda k, v: v.isNotNull()).alias("tags"), F.lit(0).cast("long").alias("area"))
    s = segments(spark, sf)
    road = F.element_at(F.create_map(*[F.lit(v) for v in ("F", "motorway", "O", "primary", "P", "residential")]), F.col("kind"))
    s = s.select("id", F.lit(2).alias("geom_type"), F.array(F.array(F.array(xy(F.col("from_x"), F.col("from_y")), xy(F.col("to_x"), F.col("to_y"))))).alias("parts"), F.create_map(F.lit("highway"), road).alias("tags"), F.lit(0).cast("long").alias("area"))
    r = rects(spark, sf)
    ring = box_ring(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    use = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("building"), F.lit("yes"))).when(F.col("id") % 3 == 1, F.create_map(F.lit("landuse"), F.lit("forest"))).otherwise(F.create_map(F.lit("natural"), F.lit("water")))
    r = r.select("id", F.lit(3).alias("geom_type"), F.array(F.array(F.concat(ring, F.slice(ring, 1, 1)))).alias("parts"), use.alias("tags"), (F.col("w") * F.col("h")).alias("area"))
    return p.unionByName(s).unionByName(r)
