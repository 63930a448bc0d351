"""Shared Spark pieces of the training-data operators: durable intermediates, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: edges that one task contracts by itself: 16 bytes each
FEW_EDGES = 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark)}/quadloom/{label}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    The written table cuts lineage and survives lost executors. The shuffle files that the
    write needed are released when it ends (they would otherwise stay until the driver
    happens to collect garbage), so the disk holds one phase at a time.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table written by save() once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quadloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], out: str, label: str) -> DataFrame:
    """Add `out`: 0, 1, 2, ... in each key group by `order`, without holding a group in one task.

    Rows are range-partitioned by (keys, order), so a key of any size spreads over many
    partitions; ranks are local to a partition and shifted by the counts of the partitions
    before it, a table of one row per partition and key.
    """
    cols = [F.col(k) for k in keys]
    own = "_partition"
    placed = save(df.repartitionByRange(*cols, *order).withColumn(own, F.spark_partition_id()), label)
    counts = placed.groupBy(own, *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(own, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(own, *keys).orderBy(*order)) - 1)
    same = local[own] == shift[own]
    for k in keys:
        same = same & local[k].eqNullSafe(shift[k])
    return local.join(shift, same).select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_shift")).cast("long").alias(out))


def _stars(batches: Iterator) -> Iterator:
    """Contract the edges of one partition to (node, smallest node of its local component)."""
    import numpy as np
    import pyarrow as pa

    a, b = [], []
    for x in batches:
        a.append(np.asarray(x.column(0)))
        b.append(np.asarray(x.column(1)))
    if not a:
        return
    ids, inv = np.unique(np.concatenate(a + b), return_inverse=True)
    half = len(inv) // 2
    u, v = inv[:half], inv[half:]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    step = 1 << 16
    for i in range(0, len(moved), step):
        m = moved[i : i + step]
        yield pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(ids[label[m]])], ["a", "b"])


def components(edges: DataFrame, label: str = "components", few: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b: long) reaches.

    Each partition first contracts its edges to stars, then large-star and small-star steps
    alternate over the whole edge table until nothing changes. Every step is written to the
    shared folder; only a count and a sum come to the driver. Nodes without an edge are absent.
    Once at most FEW_EDGES are left, one task of that bounded size contracts the rest.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = save(e.mapInArrow(_stars, "a long, b long"), label)
    seen = None
    n = now.count()
    while n > (FEW_EDGES if few is None else few):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours greater than u go to u's least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = save(small.select("x.a", "x.b").where("a <> b").distinct(), label)
        # a sum of hashes tells whether the edge set is the same as one round before
        now_seen = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(now)
        now, n = new, now_seen[0]
        if now_seen == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now_seen
    now = save(now.coalesce(1).mapInArrow(_stars, "a long, b long"), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
