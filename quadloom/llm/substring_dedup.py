"""Substring dedup by Rabin-Karp hashes of every fixed-length token window.

A word is removed if a window of 50 words over it has its word sequence also starting in a
document with a smaller doc_id. Steps, each written to the shared folder:

1. one pass hashes each document's whole word sequence and the anchors of its windows. The
   anchor of a window is the least hash of its 10-word runs, so equal windows have equal
   anchors: a window whose anchor is found in one document only is repeated nowhere.
2. documents with equal word sequences are one class: all but its smallest doc_id lose every
   word that a window covers, and only that one goes on. Anchors are counted over these.
3. the hashes (128 bits) of every window whose anchor is in two or more documents are
   counted in Spark with partial aggregation; windows with a smaller first document come back.
4. a document's repeated windows are merged into maximal removal intervals and cut out.

No step holds the rows of one window, document group or source in one task: counts combine
before the shuffle, and the join against the counts is split by AQE where a window is hot.

Defined results: a null text has no words; texts of fewer words than a window keep all; rows
that share a doc_id never remove from each other unless a smaller doc_id has the window; a
null doc_id counts as larger than any; extra columns are passed on, in `substring_dedup` without
those named like a result, in `without_repeats` all of them; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quadloom.llm._common import save
from quadloom.llm._hashing import Words, slices, spans

WINDOW = 50
GRAM = 10
LAST = (1 << 63) - 1


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketch(window: int, gram: int):
    """(ord, text) -> (ord, n_words, d1, d2, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for lo, hi in slices(list(map(len, texts))):
                w = Words(texts[lo:hi])
                d1, d2 = w.sequences()
                _, doc, anchor = w.windows(window, gram)
                change = np.ones(len(doc), dtype=bool)
                change[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                doc, anchor = doc[change], anchor[change]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                first = np.ones(len(doc), dtype=bool)
                first[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                doc, anchor = doc[first], anchor[first]
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(anchor))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), _signed(d1), _signed(d2), lists],
                    ["ord", "n_words", "d1", "d2", "anchors"],
                )

    return run


def _window_rows(window: int, gram: int):
    """(ord, text, [(d1, d2, twin, anchors)]) -> (h1, h2, ord, twin, pos) of every window with a repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, about, ords = _texts(batch.column(1)), batch.column(2).to_pylist(), np.asarray(batch.column(0))
            for lo, hi in slices(list(map(len, texts))):
                w = Words(texts[lo:hi])
                d1, d2 = (d.view(np.int64) for d in w.sequences())
                twins, known = np.full(hi - lo, -1, dtype=np.int32), []
                for i in range(hi - lo):
                    for x in about[lo + i]:
                        if x["d1"] == d1[i] and x["d2"] == d2[i]:
                            twins[i] = x["twin"]
                            known.append(np.array(x["anchors"], dtype=np.int64).view(np.uint64))
                if not known:
                    continue
                start, doc, anchor = w.windows(window, gram)
                change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, int)
                hit = np.repeat(np.isin(anchor[change], np.concatenate(known)), np.diff(np.append(change, len(anchor)))) & (twins[doc] >= 0)
                start, doc = start[hit], doc[hit]
                for a in range(0, len(start), 1 << 16):
                    s, d = start[a : a + (1 << 16)], doc[a : a + (1 << 16)]
                    h = [spans(w.sums[k], s, s + window, k) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h[0]), _signed(h[1]), pa.array(ords[lo + d]), pa.array(twins[d]), pa.array((s - w.first[d]).astype(np.int32))],
                        ["h1", "h2", "ord", "twin", "pos"],
                    )

    return run


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no window from `starts` covers."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, len(words)), -1)
    covered = np.cumsum(step[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~covered)]


def _cut(window: int, n_rest: int, text_at: int, digest: bool):
    """(rest..., text, marks) -> (rest..., [kept_text or] n_words, n_removed, kept digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = _texts(batch.column(text_at)), batch.column(batch.num_columns - 1).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, about in zip(texts, marks):
                words = text.split()
                left = words
                if about:
                    d1, d2 = (int(d.view(np.int64)[0]) for d in Words([text]).sequences())
                    for x in about:
                        if x["d1"] == d1 and x["d2"] == d2:
                            left = [] if x["whole"] else kept_words(words, np.array(x["starts"], dtype=np.int64), window)
                n_words.append(len(words)), n_removed.append(len(words) - len(left))
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(text.decode() if len(left) == len(words) else b" ".join(left).decode())
            own = [batch.column(i) for i in range(n_rest)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [f"c{i}" for i in range(n_rest + 3)])

    return run


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(ord, marks): for each doc_id that loses words, per word sequence the starts of repeated windows, or `whole`."""
    source = docs.select(F.coalesce(_column(key).cast("long"), F.lit(LAST)).alias("ord"), _column(text).alias("text"))
    sketch = save(source.mapInArrow(_sketch(window, gram), "ord long, n_words long, d1 long, d2 long, anchors array<long>"), "sketch").where(F.col("n_words") >= window)
    classes = sketch.groupBy("d1", "d2").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.first("anchors").alias("anchors"))
    classes = save(classes, "classes")
    copies = sketch.select("ord", "d1", "d2").join(classes.where("most > least").select("d1", "d2", "least"), ["d1", "d2"]).where("ord > least")
    copies = copies.select("ord", "d1", "d2", F.lit(True).alias("whole"), F.expr("cast(array() as array<int>)").alias("starts"))

    pairs = classes.select("least", "d1", "d2", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    lists = pairs.join(shared, "anchor").groupBy("least", "d1", "d2").agg(F.collect_list("anchor").alias("anchors"))
    # rows that share a doc_id but not a text are told apart by `twin`
    about = lists.groupBy("least").agg(F.sort_array(F.collect_list(F.struct("d1", "d2", "anchors"))).alias("x"))
    about = save(about.select("least", F.transform("x", lambda x, i: F.struct(x["d1"].alias("d1"), x["d2"].alias("d2"), i.alias("twin"), x["anchors"].alias("anchors"))).alias("about")), "about")

    met = source.join(about.hint("shuffle_hash"), F.col("ord") == F.col("least")).select("ord", "text", "about")
    rows = save(met.mapInArrow(_window_rows(window, gram), "h1 long, h2 long, ord long, twin int, pos int"), "windows")
    firsts = rows.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("last > first").select("h1", "h2", "first")
    again = rows.join(firsts, ["h1", "h2"]).where("ord > first").groupBy("ord", "twin").agg(F.collect_list("pos").alias("starts"))
    names = about.select("least", F.explode("about").alias("x")).select("least", "x.d1", "x.d2", "x.twin")
    partly = again.join(names, (F.col("ord") == F.col("least")) & (again["twin"] == names["twin"])).select("ord", "d1", "d2", F.lit(False).alias("whole"), "starts")
    marks = partly.union(copies.distinct()).groupBy("ord").agg(F.collect_list(F.struct("d1", "d2", "whole", "starts")).alias("_marks"))
    return save(marks, "marks")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed and the text without repeated windows (digest: its SHA-256 as kept_sha256 instead).

    A text that loses nothing stays as it is; one that loses words is the kept words joined by one space.
    """
    result = "kept_sha256" if digest else text
    made = [result.lower(), "n_words", "n_removed"]
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    out = _without(docs, rest, key, text, window, gram, digest).toDF(*rest, result, "n_words", "n_removed")
    return out.select(*[_column(c) for c in docs.columns if c in out.columns], *[_column(c) for c in out.columns if c not in docs.columns])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, in its own columns, with the text without repeated windows; rows of which nothing is left go."""
    rest = [c for c in docs.columns if c != text]
    out = _without(docs, rest, key, text, window, gram, False)
    at = {c: f"c{i}" for i, c in enumerate([*rest, text])}
    n = len(rest)
    return out.where((F.col(f"c{n + 2}") == 0) | (F.col(f"c{n + 2}") < F.col(f"c{n + 1}"))).select(*[F.col(at[c]).alias(c) for c in docs.columns])


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _without(docs: DataFrame, rest: list[str], key: str, text: str, window: int, gram: int, digest: bool) -> DataFrame:
    """c0, c1, ...: the columns of `rest`, the kept text or its digest, n_words, n_removed."""
    marks = removals(docs, key, text, window, gram)
    named = docs.select(*[_column(c).alias(f"c{i}") for i, c in enumerate(rest)], _column(text).alias("_text"), F.coalesce(_column(key).cast("long"), F.lit(LAST)).alias("_ord"))
    joined = named.join(marks.withColumnRenamed("ord", "_ord").hint("shuffle_hash"), "_ord", "left").select(*[f"c{i}" for i in range(len(rest))], "_text", "_marks")
    kinds = [*[docs.schema[c].dataType for c in rest], StringType(), LongType(), LongType()]
    return joined.mapInArrow(_cut(window, len(rest), len(rest), digest), StructType([StructField(f"c{i}", k) for i, k in enumerate(kinds)]))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same over DuckDB's `documents`: windows are compared as lists of words.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS i
         FROM (SELECT w.doc_id, w.i, unnest(range(0, {WINDOW})) AS k FROM w JOIN f USING (win) WHERE w.doc_id > f.first)),
p AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n
      FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
