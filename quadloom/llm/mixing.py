"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by
weight; a target stops at MOST_REPEATS times its source and the excess is reshared by weight.
The mix is cut into blocks of BLOCK words: Sainte-Lague gives each source whole blocks by
highest quotients, then gives each shard of a source its integer quota the same way. A shard
is walked in a seeded order: whole passes first, then blocks from the start of the order until
its quota is met, so a document is taken at most one time more often than another of its shard.

A source is cut by a seeded hash into shards of about SHARD_WORDS words and SHARD_ROWS rows,
so a source with a third of all rows is many tasks. Only one row per source and one per shard
meet in a task: shards are n / SHARD_ROWS in number, 1e5 for ten billion documents.

Defined results: null text has size 0 and is never taken; a null source is a source of its own;
rows that repeat are separate documents; with no words at all, every target is 0; an empty
table gives an empty table. `mix` passes extra columns on, but its results replace those of
their names (in any case of letters); `mixed_texts` returns all columns of docs as they are.

The method's choice of blocks is by place: a shard's blocks are BLOCK words each along its seeded
order, and the quota takes them from the start, so a document may be taken in part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm._common import save

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 16
SHARD_WORDS = 4_000_000
SHARD_ROWS = 100_000
SEED = 20_240_229


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); equal quotients go to earlier parties."""
    weights = np.asarray(weights, dtype=np.float64)
    got = np.zeros(len(weights), dtype=np.int64)
    total = weights.sum()
    if seats <= 0 or total <= 0:
        return got
    # a party has floor(w / d + 1/2) seats at divisor d; find the largest d that gives too few or just enough
    low, high = 0.0, 2 * weights.max() + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if np.floor(weights / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    got = np.floor(weights / high + 0.5).astype(np.int64)
    rest = int(seats - got.sum())
    while rest > 0:  # ties at the last divisor
        best = int(np.argmax(weights / (2 * got + 1)))
        got[best] += 1
        rest -= 1
    return got


def water_fill(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_REPEATS) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above most * size."""
    sizes, weights = np.asarray(sizes, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    target, left, open_ = np.zeros(len(sizes)), sizes.sum(), np.ones(len(sizes), dtype=bool)
    while open_.any():
        share = left * weights / weights[open_].sum()
        full = open_ & (share >= most * sizes)
        if not full.any():
            target[open_] = share[open_]
            break
        target[full] = most * sizes[full]
        left -= target[full].sum()
        open_ &= ~full
    return target


def _plan_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per source: its target and its blocks."""
    pdf = pdf.sort_values("place")
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(pdf))])
    pdf["target"] = water_fill(pdf["source_size"].to_numpy(), weights)
    total = int(pdf["source_size"].sum())
    pdf["blocks"] = sainte_lague(pdf["target"].to_numpy(), round(total / BLOCK))
    return pdf[["source", "source_size", "target", "blocks"]]


def _plan_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shards of one source: words that each gives, at most MOST_REPEATS times what it has."""
    pdf = pdf.sort_values("shard")
    sizes = pdf["shard_size"].to_numpy()
    quota = sainte_lague(sizes, int(pdf["blocks"].iloc[0])) * BLOCK
    pdf["quota"] = np.minimum(quota, MOST_REPEATS * sizes)
    return pdf[["source", "shard", "shard_size", "source_size", "target", "quota"]]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _mixed(docs: DataFrame, key: str, source: str, text: str, size: Column | None, seed: int) -> DataFrame:
    """(row, size, source_size, target, taken): row is the whole row of docs, so no name of its columns matters."""
    sized = docs.select(F.struct(*[_column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), _column(key).alias("k"), _column(source).alias("source"), (word_count(_column(text)) if size is None else size).alias("size"))
    # the small table that the plan is made of is written once: the texts aren't counted again
    per_doc = save(sized.select("k", "source", "size"), "sizes")
    totals = per_doc.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    shards_of = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_ROWS), F.lit(1)).cast("long")
    totals = save(totals.withColumn("shards", shards_of), "sources")
    # the order of sources is the only global order: one row per source
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    plan = ranked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_plan_sources, "source string, source_size long, target double, blocks long")
    plan = save(plan, "plan")

    def at(k: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(seed)), n)

    counts = totals.select(F.col("source").alias("_s"), "shards")
    placed = per_doc.join(counts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("shard", at(F.col("k"), F.col("shards")))
    shard_sizes = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    per_source = shard_sizes.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = per_source.groupBy("source").applyInPandas(_plan_shards, "source string, shard long, shard_size long, source_size long, target double, quota long")
    quotas = save(quotas.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "quotas")

    # a document's shard needs its source's shard count; both tables are one row per source or shard
    c = counts.select(F.col("_s"), F.col("shards").alias("_shards"))
    rows = sized.join(c, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_shard", at(F.col("k"), F.col("_shards")))
    q = quotas.select(F.col("source").alias("_qs"), F.col("shard").alias("_qshard"), F.col("shard_size").alias("_z"), F.col("source_size").alias("_ss"), F.col("target").alias("_t"), F.col("quota").alias("_q"))
    rows = rows.join(q, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qshard")))
    order = Window.partitionBy("source", "_shard").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    z = F.greatest(F.col("_z"), F.lit(1))
    passes = F.expr("_q div greatest(_z, 1)")
    rest = F.col("_q") - passes * z
    taken = passes * F.col("size") + F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0))
    return rows.select("row", "size", F.col("_ss").alias("source_size"), F.col("_t").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words of the document that the mix takes, repeats counted)."""
    made = ["size", "source_size", "target", "taken"]
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in made]
    return _mixed(docs, key, source, text, size, seed).select(*own, *made)


def mixed_texts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself, in the columns of docs: a document taken twice is two rows, and a part is its first words."""
    rows = _mixed(docs, key, source, text, None, seed)
    copies = rows.withColumn("_full", F.expr("case when size > 0 then taken div size else 0L end")).withColumn("_rest", F.expr("case when size > 0 then taken % size else 0L end"))
    whole = F.transform(F.sequence(F.lit(1), F.col("_full").cast("int")), lambda _: F.lit(0).cast("long"))
    each = F.concat(F.when(F.col("_full") > 0, whole).otherwise(F.expr("cast(array() as array<bigint>)")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = copies.withColumn("_part", F.explode(each))
    own = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    part = F.array_join(F.slice(F.array_remove(F.split(own[text], "[ \\t-\\r]+"), ""), 1, F.col("_part").cast("int")), " ")
    own[text] = F.when(F.col("_part") == 0, own[text]).otherwise(part)
    return rows.select(*[v.alias(c) for c, v in own.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "documents")
    return mix(sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")
