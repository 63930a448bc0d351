"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); run() writes each result to the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import mixing, packing, quality_rules, similar_texts, substring_dedup
from quadloom.llm._common import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts go (they fail the base rule); equal rows are judged alike, each by itself,
    however long; null values and names of other columns don't matter; empty in, empty out.
    """
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of its five-word shingles: that with the smallest doc_id.

    Null and wordless texts are one group; a text of under five words is one shingle. Of rows that
    share doc_id and text one stays; a null doc_id counts as larger than any. Columns keep their
    names and values, whatever they are called; empty in, empty out.
    """
    return similar_texts.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go.

    Null and short texts stay as they are; rows that share a doc_id don't remove from each other;
    a null doc_id counts as larger than any. Columns keep their names; empty in, empty out.
    """
    return substring_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, parts as texts of their first words.

    Null and wordless texts are never taken; a null source is a source of its own; equal rows are
    separate documents. Columns keep their names and values; empty in, empty out.
    """
    return mixing.mixed_texts(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in the sequences.

    A null text is one piece that holds the end id; longer texts than a sequence are cut; equal
    rows are separate documents; other columns are left out; empty in, empty out.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", repeats),
    ("mixing", mixture),
    ("best-fit packing", sequences),
]

#: Fingerprints (XXH64) and BPE can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
