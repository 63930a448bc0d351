"""Relational operators of the store: dictionaries, statistics, ordered idioms, OSM assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency_dictionary(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, n, code) of pairs found more than once, the most frequent first; ties by key and value.

    The dictionary is what repeats among metadata, small beside the data; its order is the only
    global one.
    """
    counts = pairs.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.withColumn("code", (F.row_number().over(Window.orderBy(F.desc("n"), key, value)) - 1).cast("long"))


def dict_encode(pairs: DataFrame, dictionary: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """pairs with code; where the dictionary has none, the pair stays raw (code null)."""
    out = pairs.join(dictionary.select(key, value, "code"), [key, value], "left")
    raw = F.col("code").isNull()
    return out.withColumns({"raw_key": F.when(raw, F.col(key)), "raw_value": F.when(raw, F.col(value))}).drop(key, value)


def dict_decode(coded: DataFrame, dictionary: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    out = coded.join(dictionary.select("code", key, value), "code", "left")
    return out.withColumns({key: F.coalesce(F.col(key), "raw_key"), value: F.coalesce(F.col(value), "raw_value")}).drop("code", "raw_key", "raw_value")


def layer_dimension(layers: DataFrame, layer: str = "layer") -> DataFrame:
    """(idx, layer): the coastline is 0, the others follow by name."""
    names = layers.select(F.col(layer).alias("layer")).where("layer <> 'coastline'").distinct()
    numbered = names.select(F.row_number().over(Window.orderBy("layer")).cast("long").alias("idx"), "layer")
    return numbered.union(layers.sparkSession.createDataFrame([(0, "coastline")], "idx long, layer string"))


def name_layers(rows: DataFrame, dimension: DataFrame, idx: str = "idx") -> DataFrame:
    """rows with the layer's name; an unknown index is an error."""
    out = rows.join(dimension, idx, "left")
    return out.withColumn("layer", F.when(F.col("layer").isNull(), F.raise_error(F.concat(F.lit("no layer "), F.col(idx)))).otherwise(F.col("layer")))


def size_statistics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, total, mean, q95 and most per group, q95 the value at place floor(0.95 n) from 0.

    The place comes from a ranking, not a list, so a group of any size spills instead of
    filling a task's memory.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(value)
    ranked = rows.withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(w)})
    place = F.expr("cast(floor(_n * 95 / 100) as bigint)")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("total"), (F.sum(value) / F.count(F.lit(1))).alias("mean"), F.max(F.when(F.col("_r") == place, F.col(value))).alias("q95"), F.max(value).alias("most")
    )


def islands(ids: DataFrame, key: str) -> DataFrame:
    """(first, last, n) of maximal runs of consecutive ids."""
    own = ids.select(F.col(key).alias("k")).distinct()
    # k less its rank is the same along a run; ranks are taken within blocks, and runs are joined across them
    block = F.call_function("shiftright", F.col("k"), F.lit(16))
    local = own.withColumn("_b", block).withColumn("_g", F.col("k") - F.row_number().over(Window.partitionBy("_b").orderBy("k")))
    runs = local.groupBy("_b", "_g").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    w = Window.orderBy("first")
    joined = runs.withColumn("_s", F.sum(F.when(F.lag("last").over(w) == F.col("first") - 1, 0).otherwise(1)).over(w))
    return joined.groupBy("_s").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def cumulative_histogram(rows: DataFrame, value: str, limits: tuple[int, ...]) -> DataFrame:
    return rows.agg(*[F.count(F.when(F.col(value) <= k, 1)).alias(f"le_{k}") for k in limits])


def first_use_codes(rows: DataFrame, group: str, value: str, order: str, out: str = "code") -> DataFrame:
    """(group, value, code): values numbered from 0 by first use in each group."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("_f"))
    return first.select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy("_f")) - 1).cast("long").alias(out))


def least_until(rows: DataFrame, size: str, share: float, key: str) -> DataFrame:
    """Smallest first, the rows that must go until at most `share` of the total is left."""
    w = Window.orderBy(size, key)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = rows.withColumns({"_before": before, "_total": total})
    return sums.where(F.col("_total") - F.col("_before") > F.col("_total") * share).drop("_total", "_before")


def locate_way_nodes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, ref, x, y): node locations by absolute id; missing ones are null."""
    n = nodes.select(F.abs("node_id").alias("_id"), "x", "y")
    return refs.join(n, F.abs(refs["ref"]) == F.col("_id"), "left").select("way_id", "pos", "ref", "x", "y")


def way_lines(located: DataFrame) -> DataFrame:
    """(way_id, points): a way's located nodes in order; ways with fewer than two are dropped."""
    there = located.where("x is not null").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return there.where(F.size("p") >= 2).select("way_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def line_ends(lines: DataFrame, group: str = "kind") -> DataFrame:
    """(group, x, y, degree): how many line ends meet at each point."""
    ends = lines.select(group, F.explode(F.array(F.struct(F.col("from_x").alias("x"), F.col("from_y").alias("y")), F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y")))).alias("p"))
    return ends.groupBy(group, "p.x", "p.y").agg(F.count(F.lit(1)).alias("degree"))


def dedup_metadata(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Per keys the smallest value."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value))


def collect_polygons(rows: DataFrame, *by: str) -> DataFrame:
    """Polygons of equal metadata as one: the smallest id and all parts in order of id."""
    g = rows.groupBy(*by).agg(F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct(F.col("id").alias("i"), "parts"))).alias("p"))
    return g.select(*by, "id", F.flatten(F.transform("p", lambda p: p["parts"])).alias("parts"))


def append_records(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """Records (offset, size) of each key in order of insertion."""
    g = records.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "offset", "size"))).alias("r"))
    return g.select(*key, F.transform("r", lambda r: F.struct(r["offset"].alias("offset"), r["size"].alias("size"))).alias("records"))


def running(value: Column, order: str, *by: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
