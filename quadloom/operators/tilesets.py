"""Sets of squares where a tile stands for all below it: membership, leaves, normal form, roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.tilemath import ancestors
from quadloom.operators.spatial import walk

KEY = ["z", "x", "y"]


def _lifted(tile_set: DataFrame) -> DataFrame:
    return tile_set.withColumn("_a", F.explode(ancestors(*map(F.col, KEY))))


def covered(queries: DataFrame, members: DataFrame, how: str = "left_semi") -> DataFrame:
    """Queries that are in the set or below one of its squares (left_anti: the others)."""
    q = queries.withColumn("_q", F.monotonically_increasing_id()) if how == "left_anti" else queries
    m = members.select(*[F.col(c).alias(f"_m{c}") for c in KEY]).distinct()
    up = _lifted(q)
    hit = up.join(m, (F.col("_a.z") == F.col("_mz")) & (F.col("_a.x") == F.col("_mx")) & (F.col("_a.y") == F.col("_my")), "left_semi")
    if how == "left_semi":
        return hit.drop("_a").distinct()
    return queries.join(hit.select(*KEY).distinct(), KEY, "left_anti")


def leaves_under(queries: DataFrame, members: DataFrame) -> DataFrame:
    """For each query the query itself if it is covered, else the members below it (qz, qx, qy, z, x, y)."""
    pairs = walk(queries.select(*KEY), members.select(*KEY))
    inside = pairs.where(F.col("ez") <= F.col("z")).select(*[F.col(c).alias(f"q{c}") for c in KEY], *KEY)
    below = pairs.where(F.col("ez") > F.col("z")).select(*[F.col(c).alias(f"q{c}") for c in KEY], *[F.col(f"e{c}").alias(c) for c in KEY])
    # a normal set has no member below another, so a query isn't both covered and above members
    return inside.unionByName(below).distinct()


def normalize(members: DataFrame) -> DataFrame:
    """Members without a proper ancestor in the set."""
    m = members.select(*KEY).distinct()
    above = m.select(*[F.col(c).alias(f"_m{c}") for c in KEY])
    under = _lifted(m).where(F.col("_a.z") < F.col("z")).join(above, (F.col("_a.z") == F.col("_mz")) & (F.col("_a.x") == F.col("_mx")) & (F.col("_a.y") == F.col("_my")), "left_semi")
    return m.join(under.select(*KEY).distinct(), KEY, "left_anti")


def rollup(entries: DataFrame, root_z: int, size: str = "size", offset: str = "offset") -> DataFrame:
    """Per tile from root_z down: its own size, the size of its subtree and the subtree's least offset."""
    up = entries.withColumn("_a", F.explode(ancestors(*map(F.col, KEY), least=root_z)))
    own = F.when(F.col("_a.z") == F.col("z"), F.col(size)).otherwise(F.lit(0))
    return up.groupBy(F.col("_a.z").alias("z"), F.col("_a.x").alias("x"), F.col("_a.y").alias("y")).agg(F.sum(own).alias("size_self"), F.sum(size).alias("size_subtree"), F.min(offset).alias("first_offset"))
