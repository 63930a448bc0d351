"""Tags, typed metadata, profiles, box and cardinality predicates."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.constants import SUBPIXEL_AREA
from quadloom.fixtures import sql
from quadloom.functions import geometry as geo
from quadloom.functions import tags, text
from quadloom.operators import spatial
from quadloom.plans.profile import BACKGROUND, DEFAULT, classify, min_by_area
from quadloom.queries import query

c = F.col


def _tags(spark, sf):
    p = fx.points(spark, sf)
    made = F.create_map(F.lit("place"), c("place"), F.lit("name"), c("name"), F.lit("population"), c("population"))
    return p.select("id", F.map_filter(made, lambda k, v: v.isNotNull()).alias("tags"))


@query("tag_eq", sql("SELECT id, place = 'city' AS is_city, coalesce(population, '') = '' AS no_population FROM fx_points", "fx_points"))
def run_tag_eq(spark, sf):
    return _tags(spark, sf).select("id", tags.has_tag(c("tags"), "place", "city").alias("is_city"), tags.has_tag(c("tags"), "population", "").alias("no_population"))


@query("tag_in", sql("SELECT id, population IS NOT NULL AS has_population, place IN ('town', 'borough') AS is_town FROM fx_points", "fx_points"))
def run_tag_in(spark, sf):
    return _tags(spark, sf).select("id", tags.has_any_tag(c("tags"), "population").alias("has_population"), tags.has_any_tag(c("tags"), "place", "town", "borough").alias("is_town"))


@query("tag_bool", sql("SELECT id, population <> 'true' AS value FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'true' ELSE population END AS population FROM fx_points)", "fx_points"))
def run_tag_bool(spark, sf):
    return fx.points(spark, sf).select("id", tags.tag_bool(F.when(c("id") % 5 == 0, "true").otherwise(c("population"))).alias("value"))


_NUMBERS = "SELECT id, CASE id % 6 WHEN 0 THEN population WHEN 1 THEN ' ' || id || '.5m' WHEN 2 THEN '-' || id || 'x' WHEN 3 THEN 'x' || id WHEN 4 THEN id || 'e2;7' ELSE '99999999999999999999' || id END AS v FROM fx_points"


def _numbers(spark, sf):
    i = c("id")
    v = F.when(i % 6 == 0, c("population")).when(i % 6 == 1, F.concat(F.lit(" "), i, F.lit(".5m"))).when(i % 6 == 2, F.concat(F.lit("-"), i, F.lit("x"))).when(i % 6 == 3, F.concat(F.lit("x"), i)).when(i % 6 == 4, F.concat(i, F.lit("e2;7"))).otherwise(F.concat(F.lit("99999999999999999999"), i))
    return fx.points(spark, sf).select("id", v.alias("v"))


@query("tag_num", sql(f"SELECT id, v, TRY_CAST(nullif(regexp_extract(v, '^[ \\t]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS num FROM ({_NUMBERS})", "fx_points"))
def run_tag_num(spark, sf):
    return _numbers(spark, sf).select("id", "v", tags.tag_numeric(c("v")).alias("num"))


@query("tag_int", sql(f"SELECT id, v, CAST(TRY_CAST(nullif(regexp_extract(v, '^-?[0-9]+'), '') AS BIGINT) AS DOUBLE) AS num FROM ({_NUMBERS})", "fx_points"))
def run_tag_int(spark, sf):
    return _numbers(spark, sf).select("id", "v", tags.tag_integer(c("v")).alias("num"))


@query("meta_typed", sql("""SELECT id, k, vtype, s, d, i FROM (
  SELECT id, 'flag' AS k, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS vtype, NULL AS s, NULL AS d, NULL AS i FROM fx_points UNION ALL SELECT id, 'name', 2, name, NULL, NULL FROM fx_points
  UNION ALL SELECT id, 'x', 3, NULL, CAST(x AS DOUBLE), NULL FROM fx_points UNION ALL SELECT id, 'y', 4, NULL, NULL, y FROM fx_points)""", "fx_points"))
def run_meta_typed(spark, sf):
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("flag", tags.bool_value(c("id") % 2 == 0)), ("name", tags.string_value(c("name"))), ("x", tags.numeric_value(c("x"))), ("y", tags.integer_value(c("y"))))])
    return fx.points(spark, sf).select("id", F.explode(entries).alias("m")).select("id", "m.k", c("m.v.vtype").cast("int").alias("vtype"), "m.v.s", "m.v.d", "m.v.i")


@query("meta_visible", "SELECT event_id, k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'layer' WHEN 1 THEN '__' || event_type WHEN 2 THEN '_' || event_type ELSE event_type END AS k FROM events) WHERE k <> 'layer' AND k NOT LIKE '\\_\\_%' ESCAPE '\\'")
def run_meta_visible(spark, sf):
    i, t = c("event_id"), c("event_type")
    k = F.when(i % 4 == 0, "layer").when(i % 4 == 1, F.concat(F.lit("__"), t)).when(i % 4 == 2, F.concat(F.lit("_"), t)).otherwise(t)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", k.alias("k")).where(tags.visible(c("k")))


def _flat(df):
    """Metadata as columns, one row per entry; rows without metadata once."""
    return df.select("id", "layer", "min_z", F.explode_outer("meta").alias("m")).select("id", "layer", "min_z", c("m.key").alias("key"), c("m.value.s").alias("s"), c("m.value.d").alias("d"))


_POP = "CAST(TRY_CAST(nullif(regexp_extract(population, '^-?[0-9]+'), '') AS BIGINT) AS DOUBLE)"


def _node_sql(zoom: str, layer: str) -> str:
    return f"""SELECT id, {layer} AS layer, CAST(z AS INTEGER) AS min_z, key, s, d FROM (SELECT *, {zoom} AS z FROM fx_points),
  LATERAL (SELECT 'place' AS key, place AS s, NULL::DOUBLE AS d UNION ALL SELECT 'name', name, NULL UNION ALL SELECT 'population', NULL, {_POP} WHERE {_POP} IS NOT NULL) WHERE z IS NOT NULL"""


@query("profile_node", sql(_node_sql("CASE WHEN place = 'city' THEN 5 WHEN place IN ('town', 'borough') THEN 9 WHEN place IN ('suburb', 'village') THEN 11 END", "'cities'"), "fx_points"))
def run_profile_node(spark, sf):
    return _flat(classify(_tags(spark, sf), DEFAULT.node))


@query("profile_node_background", sql(_node_sql("CASE WHEN place = 'city' THEN 6 WHEN place IN ('town', 'borough') THEN 9 WHEN place IN ('suburb', 'village') THEN 11 END", "'cities'"), "fx_points"))
def run_profile_node_background(spark, sf):
    return _flat(classify(_tags(spark, sf), BACKGROUND.node))


HIGHWAYS = ("motorway", "trunk", "motorway_link", "primary", "aeroway", "residential", "footway", "path", "proposed")
RAILWAYS = ("rail", "subway", "tram", "light_rail", "disused", "miniature")
WATERWAYS = ("river", "canal", "stream", "ditch", "weir")
_WAYS = f"""SELECT o_orderkey AS id, 
  CASE WHEN k IN (0, 3) THEN ({list(HIGHWAYS)})[1 + n % 9] END AS highway, CASE WHEN k IN (1, 3) THEN ({list(RAILWAYS)})[1 + n % 6] END AS railway,
  CASE WHEN k = 1 AND n % 7 = 0 THEN 'industrial' END AS usage, CASE WHEN k = 1 AND n % 5 = 0 THEN 'yard' END AS service, CASE WHEN k = 2 THEN ({list(WATERWAYS)})[1 + n % 5] END AS waterway,
  o_orderpriority AS name, CASE WHEN n % 2 = 0 THEN 'A' || o_custkey END AS ref FROM (SELECT *, o_orderkey % 4 AS k, o_orderkey // 4 AS n FROM orders)"""


def _ways(spark, sf):
    i = c("o_orderkey")
    k, n = i % 4, F.expr("o_orderkey div 4")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    made = F.create_map(
        F.lit("highway"), F.when(k.isin(0, 3), pick(HIGHWAYS)), F.lit("railway"), F.when(k.isin(1, 3), pick(RAILWAYS)), F.lit("usage"), F.when((k == 1) & (n % 7 == 0), "industrial"),
        F.lit("service"), F.when((k == 1) & (n % 5 == 0), "yard"), F.lit("waterway"), F.when(k == 2, pick(WATERWAYS)), F.lit("name"), c("o_orderpriority"), F.lit("ref"), F.when(n % 2 == 0, F.concat(F.lit("A"), c("o_custkey"))),
    )
    return spark.read.parquet(f"{sf}/orders.parquet").select(i.alias("id"), F.map_filter(made, lambda a, b: b.isNotNull()).alias("tags"))


def _way_sql(paths: int, gate: str, secondary: str) -> str:
    return f"""SELECT id, layer, CAST(z AS INTEGER) AS min_z, key, s, d FROM (
  SELECT id, layer, z, unnest(CASE WHEN layer = 'road' THEN list_filter([{{'key': 'highway', 's': highway}}, {{'key': 'name', 's': name}}, {{'key': 'ref', 's': CASE WHEN z < 12 THEN ref END}}], lambda e: e.s IS NOT NULL)
    WHEN layer = 'rail' THEN [{{'key': 'rail', 's': rail}}] ELSE [{{'key': NULL, 's': NULL}}] END, recursive := true), NULL::DOUBLE AS d FROM (
   SELECT *, CASE WHEN highway IS NOT NULL THEN 'road' WHEN {gate} THEN 'rail' WHEN waterway IS NOT NULL THEN 'waterway' END AS layer,
     CASE WHEN usage = 'industrial' OR service = 'yard' THEN 'detail' WHEN railway IN ({secondary}) THEN 'secondary' ELSE 'primary' END AS rail,
     CASE WHEN highway IS NOT NULL THEN CASE WHEN highway IN ('motorway', 'trunk') THEN 5 WHEN highway IN ('motorway_link', 'primary', 'aeroway') THEN 9 WHEN highway = 'residential' THEN 12 WHEN highway IN ('footway', 'path') THEN {paths} END
       WHEN {gate} THEN CASE WHEN usage = 'industrial' OR service = 'yard' THEN 14 WHEN railway IN ({secondary}) THEN 10 ELSE 5 END
       WHEN waterway IN ('river', 'canal') THEN 8 WHEN waterway = 'stream' THEN 13 WHEN waterway = 'ditch' THEN 15 END AS z FROM ({_WAYS})) WHERE z IS NOT NULL)"""


@query("profile_way", _way_sql(12, "railway IN ('rail', 'subway', 'tram')", "'subway', 'tram'"))
def run_profile_way(spark, sf):
    return _flat(classify(_ways(spark, sf), DEFAULT.way))


@query("profile_way_background", _way_sql(14, "railway IN ('rail', 'light_rail', 'subway', 'tram')", "'subway', 'tram', 'light_rail'"))
def run_profile_way_background(spark, sf):
    return _flat(classify(_ways(spark, sf), BACKGROUND.way))


#: (key, value, layer, landuse metadata, class of zooms, in the background profile)
AREAS = (
    ("building", "yes", "building", None, "b", True), ("landuse", "retail", "landuse", "retail", "d", False), ("landuse", "quarry", "landuse", "industrial", "d", False), ("amenity", "school", "landuse", "complex", "d", True),
    ("natural", "wood", "landuse", "nature_heavy", "d", False), ("landuse", "meadow", "landuse", "nature_light", "d", False), ("leisure", "park", "landuse", "park", "d", False), ("landuse", "cemetery", "landuse", "cemetery", "d", True),
    ("landuse", "greenfield", "construction", None, "d", True), ("natural", "water", "water", None, "w", True), ("natural", "beach", "landuse", "beach", "d", True), ("amenity", "parking", "pedestrian", None, "p", True), ("leisure", "pitch", "sport", None, "s", True), ("shop", "yes", None, None, None, True),
)
_ZOOMS = {"b": "CASE WHEN a < 100000000 THEN 14 WHEN a < 10000000000 THEN 12 ELSE 10 END", "d": "CASE WHEN a < 100000000 THEN 14 WHEN a < 10000000000 THEN 10 ELSE 8 END", "w": "CASE WHEN a < 1000000 THEN 12 WHEN a < 10000 THEN 10 ELSE 0 END", "p": "CASE WHEN a < 100000000 THEN 12 WHEN a < 10000000000 THEN 10 ELSE 8 END", "s": "CASE WHEN a < 100000000 THEN 14 WHEN a < 10000000000 THEN 12 ELSE 8 END"}


def _areas(spark, sf):
    kinds = F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v, *_ in AREAS])
    return fx.rects(spark, sf).select("id", F.element_at(kinds, (c("id") % len(AREAS) + 1).cast("int")).alias("tags"), (c("w") * c("h")).alias("a"))


def _area_sql(background: bool) -> str:
    rows = [(i, *x) for i, x in enumerate(AREAS) if x[2] and (x[5] or not background)]
    layer = " ".join(f"WHEN {i} THEN '{r[2]}'" for i, *r in rows)
    use = " ".join(f"WHEN {i} THEN '{r[3]}'" for i, *r in rows if r[3])
    zoom = " ".join(f"WHEN {i} THEN {_ZOOMS[r[4]]}" for i, *r in rows)
    return sql(f"SELECT id, layer, CAST(z AS INTEGER) AS min_z, CASE WHEN s IS NOT NULL THEN 'landuse' END AS key, s, NULL::DOUBLE AS d FROM (SELECT id, CASE id % {len(AREAS)} {layer} END AS layer, CASE id % {len(AREAS)} {use} END AS s, CASE id % {len(AREAS)} {zoom} END AS z FROM (SELECT id, w * h AS a FROM fx_rects)) WHERE z IS NOT NULL", "fx_rects")


@query("profile_area", _area_sql(False))
def run_profile_area(spark, sf):
    return _flat(classify(_areas(spark, sf), DEFAULT.area, area="a"))


@query("profile_area_background", _area_sql(True))
def run_profile_area_background(spark, sf):
    return _flat(classify(_areas(spark, sf), BACKGROUND.area, area="a"))


@query("area_class", sql(f"SELECT CAST({_ZOOMS['d'].replace('a <', 'w * h <')} AS INTEGER) AS min_z, count(*) AS n FROM fx_rects GROUP BY ALL", "fx_rects"))
def run_area_class(spark, sf):
    return fx.rects(spark, sf).groupBy(min_by_area(c("w") * c("h"), ((14, 10**8), (10, 10**10), (8, -1))).alias("min_z")).agg(F.count(F.lit(1)).alias("n"))


@query("zoom_filter", sql("SELECT id, 8 + id % 6 AS min_z FROM fx_rects WHERE 8 + id % 6 <= 10 AND 10 <= 21", "fx_rects"))
def run_zoom_filter(spark, sf):
    return fx.rects(spark, sf).select("id", (8 + c("id") % 6).alias("min_z"), F.lit(21).alias("max_z")).where((c("min_z") <= 10) & (c("max_z") >= 10)).select("id", "min_z")


_B = (2260000000, 1460000000, 2290000000, 1490000000)


def _box():
    return [F.lit(v) for v in _B]


def _own():
    return [c(k) for k in spatial.BOX]


@query("bbox_filter", sql(f"SELECT id FROM fx_rects WHERE min_x <= {_B[2]} AND max_x >= {_B[0]} AND min_y <= {_B[3]} AND max_y >= {_B[1]}", "fx_rects"))
def run_bbox_filter(spark, sf):
    return fx.rects(spark, sf).where(geo.boxes_touch(_own(), _box())).select("id")


@query("box_touches", sql(f"SELECT id, min_x <= {_B[2]} AND max_x >= {_B[0]} AND min_y <= {_B[3]} AND max_y >= {_B[1]} AS touches FROM fx_rects", "fx_rects"))
def run_box_touches(spark, sf):
    return fx.rects(spark, sf).select("id", geo.boxes_touch(_own(), _box()).alias("touches"))


@query("box_within", sql(f"SELECT id, min_x >= {_B[0]} AND max_x <= {_B[2]} AND min_y >= {_B[1]} AND max_y <= {_B[3]} AS within FROM fx_rects", "fx_rects"))
def run_box_within(spark, sf):
    return fx.rects(spark, sf).select("id", geo.box_within(_own(), _box()).alias("within"))


def _ring():
    return geo.box_ring(*_own())


_CORNERS = "SELECT id, unnest([{'i': 0, 'x': min_x, 'y': min_y}, {'i': 1, 'x': max_x, 'y': min_y}, {'i': 2, 'x': max_x, 'y': max_y}, {'i': 3, 'x': min_x, 'y': max_y}], recursive := true) FROM fx_rects"


def _numbered(df, points):
    return df.select("id", F.posexplode(points).alias("i", "p")).select("id", "i", "p.x", "p.y")


@query("box_path", sql(f"SELECT id, CAST(i AS INTEGER) AS i, x, y FROM ({_CORNERS})", "fx_rects"))
def run_box_path(spark, sf):
    return _numbered(fx.rects(spark, sf), _ring())


@query("ring_close", sql(f"SELECT id, CAST(i AS INTEGER) AS i, x, y FROM ({_CORNERS}) UNION ALL SELECT id, 4, min_x, min_y FROM fx_rects", "fx_rects"))
def run_ring_close(spark, sf):
    return _numbered(fx.rects(spark, sf), geo.close_ring(geo.close_ring(_ring())))


@query("ring_filter", sql("SELECT id, n FROM (SELECT id, CAST(3 + id % 3 AS INTEGER) AS n FROM fx_rects) WHERE n >= 4", "fx_rects"))
def run_ring_filter(spark, sf):
    ring = F.slice(geo.close_ring(_ring()), F.lit(1), (3 + c("id") % 3).cast("int"))
    return fx.rects(spark, sf).select("id", ring.alias("r")).where(geo.ring_ok(c("r"))).select("id", F.size("r").alias("n"))


@query("subpixel_drop", sql(f"SELECT id, px_area FROM (SELECT id, ((max_x >> 10) - (min_x >> 10)) * ((max_y >> 10) - (min_y >> 10)) AS px_area FROM fx_rects) WHERE px_area >= {SUBPIXEL_AREA} OR id % 10 = 0", "fx_rects"))
def run_subpixel_drop(spark, sf):
    ring = geo.close_ring(geo.quantize(_ring(), F.lit(10)))
    rows = fx.rects(spark, sf).select("id", geo.ring_area(ring).alias("px_area"))
    return rows.where((c("px_area") >= SUBPIXEL_AREA) | (c("id") % 10 == 0))


@query("pack_file_name", "SELECT event_id, CASE WHEN f LIKE '%.mdb' THEN left(f, length(f) - 4) || '.pck' ELSE f || '.pck' END AS file FROM (SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '.mdb' ELSE '.db' END AS f FROM events)")
def run_pack_file_name(spark, sf):
    name = F.concat(c("event_type"), F.when(c("event_id") % 2 == 0, ".mdb").otherwise(".db"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.pack_file_name(name).alias("file"))




@query("fmt_bytes", "SELECT id, CASE WHEN v >= 1073741824 THEN printf('%7.2f', CAST(v AS DOUBLE) / 1073741824) || 'GB' WHEN v >= 1048576 THEN printf('%7.2f', CAST(v AS DOUBLE) / 1048576) || 'MB' WHEN v >= 1024 THEN printf('%7.2f', CAST(v AS DOUBLE) / 1024) || 'KB' ELSE printf('%7.2f', CAST(v AS DOUBLE)) || 'B ' END AS bytes FROM (SELECT o_orderkey AS id, (CAST(1 AS BIGINT) << CAST(o_orderkey % 36 AS INT)) AS v FROM orders)")
def run_fmt_bytes(spark, sf):
    v = F.call_function("shiftleft", F.lit(1).cast("long"), (c("o_orderkey") % 36).cast("int"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(c("o_orderkey").alias("id"), text.readable_bytes(v).alias("bytes"))


@query("fmt_ns", "SELECT id, CASE WHEN v >= 1000000000 THEN printf('%7.3f', CAST(v AS DOUBLE) / 1000000000) || 's ' WHEN v >= 1000000 THEN printf('%7.3f', CAST(v AS DOUBLE) / 1000000) || 'ms' WHEN v >= 1000 THEN printf('%7.3f', CAST(v AS DOUBLE) / 1000) || chr(181) || 's' ELSE printf('%7.3f', CAST(v AS DOUBLE)) || 'ns' END AS ns FROM (SELECT o_orderkey AS id, (CAST(1 AS BIGINT) << CAST(o_orderkey % 36 AS INT)) AS v FROM orders)")
def run_fmt_ns(spark, sf):
    v = F.call_function("shiftleft", F.lit(1).cast("long"), (c("o_orderkey") % 36).cast("int"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(c("o_orderkey").alias("id"), text.readable_ns(v).alias("ns"))
