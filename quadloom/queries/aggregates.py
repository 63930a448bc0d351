"""Dictionaries, dedup, statistics, ordered idioms and window forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.fixtures import sql
from quadloom.functions import geometry as geo
from quadloom.operators import spatial, tables
from quadloom.queries import query
from quadloom.queries.geometry import rect_parts

c = F.col

_DICT = "dict AS (SELECT key, value, n, row_number() OVER (ORDER BY n DESC, key, value) - 1 AS code FROM (SELECT key, value, count(*) AS n FROM fx_events_kv GROUP BY ALL) WHERE n > 1)"


def _dict_sql(body: str) -> str:
    return f"WITH fx_events_kv AS ({fx.SQL['fx_events_kv']}), {_DICT} {body}"


@query("meta_dict", _dict_sql("SELECT key, value, n, code FROM dict"))
def run_meta_dict(spark, sf):
    return tables.frequency_dictionary(fx.events_kv(spark, sf))


_RARE = "SELECT event_id, key, CASE WHEN event_id % 10 = 0 THEN value || event_id ELSE value END AS value FROM fx_events_kv"


def _rare(spark, sf):
    return fx.events_kv(spark, sf).withColumn("value", F.when(c("event_id") % 10 == 0, F.concat("value", "event_id")).otherwise(c("value")))


@query("dict_encode", _dict_sql(f"SELECT e.event_id, d.code, CASE WHEN d.code IS NULL THEN e.key END AS raw_key, CASE WHEN d.code IS NULL THEN e.value END AS raw_value FROM ({_RARE}) e LEFT JOIN dict d USING (key, value)"))
def run_dict_encode(spark, sf):
    return tables.dict_encode(_rare(spark, sf), tables.frequency_dictionary(fx.events_kv(spark, sf))).select("event_id", "code", "raw_key", "raw_value")


@query("dict_decode", sql(f"SELECT event_id, key, value FROM ({_RARE})", "fx_events_kv"))
def run_dict_decode(spark, sf):
    d = tables.frequency_dictionary(fx.events_kv(spark, sf))
    return tables.dict_decode(tables.dict_encode(_rare(spark, sf), d), d).select("event_id", "key", "value")


@query("layer_dim", "SELECT event_id, idx, layer FROM (SELECT event_id, (event_id % (SELECT count(DISTINCT event_type) + 1 FROM events)) AS idx FROM events) JOIN (SELECT row_number() OVER (ORDER BY event_type) AS idx, event_type AS layer FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 0, 'coastline') USING (idx)")
def run_layer_dim(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    dim = tables.layer_dimension(e, "event_type")
    n = dim.count()
    return tables.name_layers(e.select("event_id", (c("event_id") % n).alias("idx")), dim).select("event_id", "idx", "layer")


@query("endpoint_degree", sql("SELECT kind, x, y, count(*) AS degree FROM (SELECT kind, from_x AS x, from_y AS y FROM fx_segments UNION ALL SELECT kind, to_x, to_y FROM fx_segments) GROUP BY ALL", "fx_segments"))
def run_endpoint_degree(spark, sf):
    return tables.line_ends(fx.segments(spark, sf))


@query("poly_collect", sql("SELECT kind, min(id) AS id, CAST(count(*) AS INTEGER) AS n_parts FROM fx_rects GROUP BY kind", "fx_rects"))
def run_poly_collect(spark, sf):
    rows = fx.rects(spark, sf).select("id", "kind", rect_parts().alias("parts"))
    return tables.collect_polygons(rows, "kind").select("kind", "id", F.size("parts").alias("n_parts"))


@query("bbox_agg", sql("SELECT kind, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM fx_rects GROUP BY kind", "fx_rects"))
def run_bbox_agg(spark, sf):
    boxes = fx.rects(spark, sf).select("kind", geo.bounding_box(F.flatten(F.flatten(rect_parts()))).alias("b")).select("kind", "b.*")
    return boxes.groupBy("kind").agg(*[f(k).alias(k) for k, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))])


@query("dataset_bounds", sql("SELECT min(min_x >> 22) AS min_x, min(min_y >> 22) AS min_y, max(max_x >> 22) AS max_x, max(max_y >> 22) AS max_y FROM fx_rects", "fx_rects"))
def run_dataset_bounds(spark, sf):
    from quadloom.plans.render import dataset_bounds

    return dataset_bounds(spatial.assign_cells(fx.rects(spark, sf)))


@query("layer_counts", f"""WITH p AS ({fx.SQL['fx_points']}), t AS (SELECT unnest(range(CAST(536 AS BIGINT), CAST(552 AS BIGINT))) AS x), u AS (SELECT unnest(range(CAST(345 AS BIGINT), CAST(361 AS BIGINT))) AS y)
SELECT CAST(10 AS BIGINT) AS z, x, y, layer, count(*) AS n_features, count(DISTINCT qx * 4096 + qy) AS n_places FROM (
  SELECT p.x >> 22 AS x, p.y >> 22 AS y, p.place AS layer, p.x >> 10 AS qx, p.y >> 10 AS qy FROM p WHERE place <> 'hamlet'
    AND p.x > ((p.x >> 22) << 22) - 4096 AND p.x < (((p.x >> 22) + 1) << 22) + 4096) GROUP BY ALL""")
def run_layer_counts(spark, sf):
    """The flagship: points to cells, squares of zoom 10, zoom and box predicates, dedup, clip, quantise, count per layer."""
    p = fx.points(spark, sf).where("place <> 'hamlet'")
    store = p.select("id", c("place").alias("layer"), F.lit(1).alias("geom_type"), F.lit(5).alias("min_z"), F.lit(21).alias("max_z"), *[c(k[-1]).alias(k) for k in spatial.BOX])
    store = spatial.assign_cells(store)
    tile_set = fx.requests(spark, zooms=(10, 10))
    rows = spatial.dedup_in_tile(spatial.match(store, tile_set))
    rows = rows.where(geo.in_box(c("min_x"), c("min_y"), *spatial.draw_box()))
    q = geo.quantize(F.array(geo.xy(c("min_x"), c("min_y"))), c("z"))[0]
    return rows.groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n_features"), F.countDistinct(q["x"] * 4096 + q["y"]).alias("n_places"))


def _q95(by: str, value: str) -> str:
    return f"SELECT {by}, count(*) AS n, CAST(sum({value}) AS BIGINT) AS total, sum({value}) / CAST(count(*) AS DOUBLE) AS mean, list_sort(list({value}))[1 + CAST(floor(count(*) * 95 / 100) AS BIGINT)] AS q95, max({value}) AS most"


@query("q95_stats", sql(_q95("kind", "w") + " FROM fx_rects GROUP BY kind", "fx_rects"))
def run_q95_stats(spark, sf):
    return tables.size_statistics(fx.rects(spark, sf), "w", "kind")


@query("perf_report", _q95("event_type AS task", "v") + " FROM (SELECT event_type, event_id * 7919 % 10007 AS v FROM events) GROUP BY event_type")
def run_perf_report(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(c("event_type").alias("task"), (c("event_id") * 7919 % 10007).alias("v"))
    return tables.size_statistics(e, "v", "task")


@query("prepare_stats", sql("""SELECT 8 + id % 4 AS z, count(*) AS n_total, count(CASE WHEN h % 8000 = 0 THEN 1 END) AS n_empty, count(CASE WHEN h % 8000 <> 0 THEN 1 END) AS n_filled, CAST(sum(CASE WHEN h % 8000 <> 0 THEN w ELSE 0 END) AS BIGINT) AS size FROM fx_rects GROUP BY ALL""", "fx_rects"))
def run_prepare_stats(spark, sf):
    rows = fx.rects(spark, sf).select((8 + c("id") % 4).alias("z"), F.when(c("h") % 8000 != 0, c("w")).alias("size"))
    return rows.groupBy("z").agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(c("size").isNull(), 1)).alias("n_empty"), F.count("size").alias("n_filled"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


@query("db_stats", sql("""SELECT cell_x, cell_y, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, sum(w) / CAST(count(*) AS DOUBLE) AS mean, list_sort(list(w))[1 + CAST(floor(count(*) * 95 / 100) AS BIGINT)] AS q95, max(w) AS most FROM (SELECT w, cell_x, unnest(range(min_y >> 22, (max_y >> 22) + 1)) AS cell_y FROM (SELECT *, unnest(range(min_x >> 22, (max_x >> 22) + 1)) AS cell_x FROM fx_rects)) GROUP BY cell_x, cell_y""", "fx_rects"))
def run_db_stats(spark, sf):
    return tables.size_statistics(spatial.assign_cells(fx.rects(spark, sf)), "w", "cell_x", "cell_y")


@query("meta_dedup", "SELECT user_id, event_type, min(props) AS value FROM events GROUP BY ALL")
def run_meta_dedup(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", c("props").alias("value"))
    return tables.dedup_metadata(e, "user_id", "event_type")


_ISLANDS = "SELECT min(node_id) AS first, max(node_id) AS last, count(*) AS n FROM (SELECT node_id, node_id - row_number() OVER (ORDER BY node_id) AS g FROM (SELECT DISTINCT node_id FROM ({})) ) GROUP BY g"
_GAPS = "SELECT node_id FROM fx_nodes"


@query("node_spans", sql(_ISLANDS.format(_GAPS), "fx_nodes"))
def run_node_spans(spark, sf):
    return tables.islands(fx.nodes(spark, sf), "node_id")


@query("span_hist", sql("SELECT " + ", ".join(f"count(CASE WHEN n <= {k} THEN 1 END) AS le_{k}" for k in (1, 4, 8, 64, 1000)) + f" FROM ({_ISLANDS.format(_GAPS)})", "fx_nodes"))
def run_span_hist(spark, sf):
    return tables.cumulative_histogram(run_node_spans(spark, sf), "n", (1, 4, 8, 64, 1000))


@query("pack_records", "SELECT user_id, i - 1 AS place, r.o AS offset_, r.s AS size FROM (SELECT user_id, unnest(range(1, len(rs) + 1)) AS i, rs FROM (SELECT user_id, list({'e': event_id, 'o': event_id * 100, 's': event_id % 97} ORDER BY event_id) AS rs FROM events GROUP BY user_id)), LATERAL (SELECT rs[i] AS r)".replace("r.o", "rs[i].o").replace("r.s", "rs[i].s").replace(", LATERAL (SELECT rs[i] AS r)", ""))
def run_pack_records(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", (c("event_id") * 100).alias("offset"), (c("event_id") % 97).alias("size"))
    rows = tables.append_records(e, ["user_id"], "event_id").select("user_id", F.posexplode("records").alias("place", "r"))
    return rows.select("user_id", c("place").cast("long").alias("place"), c("r.offset").alias("offset_"), "r.size")


@query("tag_codes", "SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY f) - 1 AS code FROM (SELECT event_type, props, min(event_id) AS f FROM events GROUP BY ALL)")
def run_tag_codes(spark, sf):
    return tables.first_use_codes(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "props", "event_id")


@query("delta_window", sql("SELECT way_id, pos, ref - lag(ref, 1, 0) OVER (PARTITION BY way_id ORDER BY pos) AS delta FROM fx_way_nodes", "fx_way_nodes"))
def run_delta_window(spark, sf):
    w = Window.partitionBy("way_id").orderBy("pos")
    return fx.way_nodes(spark, sf).select("way_id", "pos", (c("ref") - F.lag("ref", 1, 0).over(w)).alias("delta"))


@query("undelta_window", sql("SELECT way_id, pos, CAST(sum(ref) OVER (PARTITION BY way_id ORDER BY pos) AS BIGINT) AS value FROM fx_way_nodes", "fx_way_nodes"))
def run_undelta_window(spark, sf):
    return fx.way_nodes(spark, sf).select("way_id", "pos", tables.running(c("ref"), "pos", "way_id").alias("value"))


@query("geom_delta", sql("SELECT way_id, pos, ref - lag(ref, 1, 2147483648) OVER (PARTITION BY way_id ORDER BY pos) AS delta, ref AS back FROM fx_way_nodes", "fx_way_nodes"))
def run_geom_delta(spark, sf):
    lists = fx.way_nodes(spark, sf).groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda p: p["ref"]).alias("v"))
    coded = lists.withColumn("d", geo.deltas(c("v"), 1 << 31)).withColumn("b", geo.undelta(c("d"), 1 << 31))
    rows = coded.select("way_id", F.posexplode(F.arrays_zip("d", "b")).alias("pos", "e"))
    return rows.select("way_id", c("pos").cast("long").alias("pos"), c("e.d").alias("delta"), c("e.b").alias("back"))


@query("consecutive_dedup", sql("SELECT way_id, v, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS place FROM (SELECT way_id, pos, abs(ref) % 3 AS v, lag(abs(ref) % 3) OVER (PARTITION BY way_id ORDER BY pos) AS p FROM fx_way_nodes) WHERE p IS NULL OR p <> v", "fx_way_nodes"))
def run_consecutive_dedup(spark, sf):
    lists = fx.way_nodes(spark, sf).groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda p: F.abs(p["ref"]) % 3).alias("v"))
    rows = lists.select("way_id", F.posexplode(geo.consecutive_dedup(c("v"))).alias("place", "v"))
    return rows.select("way_id", "v", c("place").cast("long").alias("place"))


@query("flush_topk", sql("""SELECT cell, n FROM (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT (min_y >> 22) * 1024 + (min_x >> 22) AS cell, count(*) AS n FROM fx_rects GROUP BY ALL)) WHERE total - before > total * 0.75""", "fx_rects"))
def run_flush_topk(spark, sf):
    cell = F.call_function("shiftright", c("min_y"), F.lit(22)) * 1024 + F.call_function("shiftright", c("min_x"), F.lit(22))
    sizes = fx.rects(spark, sf).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return tables.least_until(sizes, "n", 0.75, "cell")
