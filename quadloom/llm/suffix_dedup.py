"""Suffix-array dedup: bytes covered by a 200-byte string that also starts anywhere else.

Repeats are found by merging Burrows-Wheeler transforms of shards (bwt.py). What may repeat
is brought together first, so that a shard is a bounded piece and no task sees the corpus:

1. Texts that are equal as a whole are one class: if they hold a window, all of it repeats.
2. The anchor of a window is the place of the least hash of its 32-byte runs; equal windows
   have equal anchors at the same place in them. A window whose anchor is found once repeats
   nowhere. This leaves out most text and no repeat.
3. Windows of an anchor are taken in groups of 32 starts. All of a group hold a common core of
   169 bytes; equal windows lie in groups of equal cores. Groups are counted by (core, whole
   content) in Spark: equal contents repeat as they are.
4. Contents that share a core but differ are read once each; whole cores, a bounded number of
   bytes at a time, are cut into shards, transformed and merged; places whose common prefix
   reaches 200 are repeats. A core with over MOST_CONTENTS contents is counted by the hashes
   of its single windows instead, so nothing is held or left out.

Hashes carry 128 bits. Defined results: a null text is empty; rows that repeat are documents of
their own, so all their windows repeat; matches never cross documents; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm._common import save
from quadloom.llm._hashing import U, grams, prefix, sliding, slices, spans
from quadloom.llm.bwt import repeated

WIDTH = 200
GRAM = 32
STEP = 32
#: Contents merged at a time: 16 bits then number all 8-byte characters.
BATCH_BYTES = 56 << 10
MOST_CONTENTS = 4096
PLACE = (1 << 28) - 1


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Bytes:
    """The bytes of some texts with rolling hashes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(U) + U(1)
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
        self.sums = [prefix(data, w) for w in (0, 1)]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(spans(self.sums[w], self.begin[:-1], self.begin[1:], w) for w in (0, 1))

    def runs(self, width: int, gram: int) -> tuple[np.ndarray, ...]:
        """(text, place of the anchor, its hash, first window, last window) of each run of windows with one anchor."""
        g = grams(self.sums[0], gram)
        least = sliding((g & ~U(PLACE)) | np.arange(len(g), dtype=U), width - gram + 1)
        counts = np.maximum(np.diff(self.begin) - width + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(text)) - np.concatenate([[0], np.cumsum(counts)])[:-1][text] + self.begin[:-1][text]
        owner = (least[start] & U(PLACE)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, dtype=np.int64)
        last = np.append(edge[1:], len(text)) - 1 if len(edge) else edge
        return text[edge], owner[edge], g[owner[edge]] if len(edge) else np.zeros(0, U), start[edge], start[last]


def _sketch(width: int, gram: int):
    """(ord, text) -> (ord, n, d1, d2, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for lo, hi in slices(list(map(len, texts))):
                b = Bytes(texts[lo:hi])
                d1, d2 = b.names()
                doc, _, anchor, _, _ = b.runs(width, gram)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.ascontiguousarray(anchor)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(b.begin)), _signed(d1), _signed(d2), lists], ["ord", "n", "d1", "d2", "anchors"])

    return run


def _groups(width: int, gram: int, step: int):
    """(ord, text, about) -> (c1, c2, x1, x2, shape, ord, twin, a): groups of windows with a repeated anchor.

    shape is (core start - a) * 64 + number of windows; a is the first window's place in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, about, ords = _texts(batch.column(1)), batch.column(2).to_pylist(), np.asarray(batch.column(0))
            for lo, hi in slices(list(map(len, texts))):
                b = Bytes(texts[lo:hi])
                d1, d2 = (d.view(np.int64) for d in b.names())
                twins, known = np.full(hi - lo, -1, dtype=np.int32), []
                for i in range(hi - lo):
                    for x in about[lo + i]:
                        if x["d1"] == d1[i] and x["d2"] == d2[i]:
                            twins[i] = x["twin"]
                            known.append(np.array(x["anchors"], dtype=np.int64).view(U))
                if not known:
                    continue
                doc, p, anchor, s1, s2 = b.runs(width, gram)
                hit = np.isin(anchor, np.concatenate(known)) & (twins[doc] >= 0)
                doc, p, s1, s2 = doc[hit], p[hit], s1[hit], s2[hit]
                q1, q2 = (p - s2) // step, (p - s1) // step
                times = q2 - q1 + 1
                row = np.repeat(np.arange(len(p)), times)
                q = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + q1[row]
                core = p[row] - step * q
                a, z = np.maximum(s1[row], core - step + 1), np.minimum(s2[row], core)
                for i in range(0, len(row), 1 << 16):
                    k = slice(i, i + (1 << 16))
                    own = doc[row[k]]
                    c = [spans(b.sums[w], core[k], core[k] - step + 1 + width, w) for w in (0, 1)]
                    x = [spans(b.sums[w], a[k], z[k] + width, w) for w in (0, 1)]
                    shape = (core[k] - a[k]) * 64 + (z[k] - a[k] + 1)
                    yield pa.RecordBatch.from_arrays(
                        [*map(_signed, c), *map(_signed, x), pa.array(shape.astype(np.int32)), pa.array(ords[lo + own]), pa.array(twins[own]), pa.array((a[k] - b.begin[own]).astype(np.int32))],
                        ["c1", "c2", "x1", "x2", "shape", "ord", "twin", "a"],
                    )

    return run


def _contents(width: int):
    """(ord, text, [(d1, d2, a, n, cid, c1, hot)]) -> (c1, c2, cid, content, h1, h2, at): a content, or each window of a hot core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for text, about in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                b = Bytes([text])
                d1, d2 = (int(d.view(np.int64)[0]) for d in b.names())
                for x in about:
                    if x["d1"] != d1 or x["d2"] != d2:
                        continue
                    rows = [(x["c1"], x["c2"], x["cid"], text[x["a"] : x["a"] + x["n"] - 1 + width], None, None, None)]
                    if x["hot"]:
                        s = np.arange(x["a"], x["a"] + x["n"])
                        h = [spans(b.sums[w], s, s + width, w).view(np.int64).tolist() for w in (0, 1)]
                        rows = [(x["c1"], x["c2"], x["cid"], None, u, v, i) for i, (u, v) in enumerate(zip(*h))]
                    for row in rows:
                        for column, value in zip(out, row):
                            column.append(value)
                        size += len(row[3] or b"") + 40
                if size > 4 << 20:
                    yield pack(out)
                    out, size = [[] for _ in range(7)], 0
            yield pack(out)

    def pack(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["c1", "c2", "cid", "content", "h1", "h2", "at"])

    return run


def _merged(width: int, batch_bytes: int):
    """Over (c1, c2, cid, content) sorted by core: (cid, at) of windows that repeat, whole cores at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work(rows):
            found = repeated([r[3] for r in rows], width)
            cids = np.repeat([r[2] for r in rows], [len(f) for f in found]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(np.concatenate(found).astype(np.int32))], ["cid", "at"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > batch_bytes and row[:2] != held[-1][:2]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield work(held)

    return run


def covered(n: int, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Bytes of n that the windows starting in any [lo, hi] cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, np.minimum(hi + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def _cut(width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, pieces, kept = [], [], [], []
            for text, about in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                gone, left, runs = 0, text, 0
                if about:
                    d1, d2 = (int(d.view(np.int64)[0]) for d in Bytes([text]).names())
                    for x in about:
                        if x["d1"] == d1 and x["d2"] == d2:
                            if x["whole"]:
                                gone, left, runs = len(text), b"", 1
                                break
                            lo, hi = (np.array([s[k] for s in x["spans"]], dtype=np.int64) for k in ("lo", "hi"))
                            mask = covered(len(text), lo, hi, width)
                            gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                            left = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                n.append(len(text)), removed.append(gone), pieces.append(runs)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], [f"c{i}" for i in range(5)])

    return run


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, step: int = STEP, most: int = MOST_CONTENTS, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept is the remaining bytes, or with digest kept_sha256."""
    if step > 63 or step + gram > width:
        raise ValueError("a group's core must hold an anchor")
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("ord"), F.col(text).alias("text"))
    sketch = save(source.mapInArrow(_sketch(width, gram), "ord long, n long, d1 long, d2 long, anchors array<long>"), "sketch").where(F.col("n") >= width)
    classes = sketch.groupBy("d1", "d2").agg(F.min("ord").alias("least"), F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"))
    classes = save(classes, "classes")
    copies = sketch.select("ord", "d1", "d2").join(classes.where("n > 1").select("d1", "d2"), ["d1", "d2"]).distinct()

    pairs = classes.select("least", "d1", "d2", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    lists = pairs.join(shared, "anchor").groupBy("least", "d1", "d2").agg(F.collect_set("anchor").alias("anchors"))
    about = lists.groupBy("least").agg(F.sort_array(F.collect_list(F.struct("d1", "d2", "anchors"))).alias("x"))
    about = save(about.select("least", F.transform("x", lambda x, i: F.struct(x["d1"].alias("d1"), x["d2"].alias("d2"), i.alias("twin"), x["anchors"].alias("anchors"))).alias("about")), "about")
    names = about.select("least", F.explode("about").alias("x")).select("least", "x.d1", "x.d2", "x.twin")

    met = source.join(about.hint("shuffle_hash"), F.col("ord") == F.col("least")).select("ord", "text", "about")
    groups = save(met.mapInArrow(_groups(width, gram, step), "c1 long, c2 long, x1 long, x2 long, shape int, ord long, twin int, a int"), "groups")
    content = ["c1", "c2", "x1", "x2", "shape"]
    counted = groups.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "twin", "a")).alias("one"))
    counted = save(counted.withColumn("cid", F.monotonically_increasing_id()), "contents")
    windows = F.col("shape") % 64
    same = groups.join(counted.where("n > 1").select(*content), content).select("ord", "twin", F.col("a").alias("lo"), (F.col("a") + windows - 1).alias("hi"))

    cores = counted.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    need = counted.join(cores, ["c1", "c2"]).select("c1", "c2", "cid", "one.*", windows.alias("n"), (F.col("kinds") > most).alias("hot"))
    need = need.join(names.withColumnsRenamed({"least": "ord", "twin": "t"}), "ord").where("twin = t")
    need = need.groupBy("ord").agg(F.collect_list(F.struct("d1", "d2", "a", "n", "cid", "c1", "c2", "hot")).alias("about"))
    read = source.join(need.hint("shuffle_hash"), "ord").select("ord", "text", "about")
    # rows that share doc_id and text give the same content again: once is enough
    read = save(read.mapInArrow(_contents(width), "c1 long, c2 long, cid long, content binary, h1 long, h2 long, at int"), "read")
    single = read.where("content is not null").dropDuplicates(["cid"]).select("c1", "c2", "cid", "content")
    merged = single.repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(_merged(width, BATCH_BYTES), "cid long, at int")
    each = read.where("content is null").select("h1", "h2", "cid", "at").dropDuplicates(["cid", "at"])
    hot = each.join(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"]).select("cid", "at")
    # only a content found once needs them; it lies where it was read
    unique = counted.where("n = 1").select("cid", "one.*")
    differ = merged.union(hot).join(unique, "cid").select("ord", "twin", (F.col("a") + F.col("at")).alias("lo"), (F.col("a") + F.col("at")).alias("hi"))

    marks = same.union(differ).groupBy("ord", "twin").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    partly = marks.join(names.withColumnsRenamed({"least": "ord", "twin": "t"}), "ord").where("twin = t").select("ord", "d1", "d2", F.lit(False).alias("whole"), "spans")
    whole = copies.select("ord", "d1", "d2", F.lit(True).alias("whole"), F.expr("cast(array() as array<struct<lo: int, hi: int>>)").alias("spans"))
    marks = save(partly.union(whole).groupBy("ord").agg(F.collect_list(F.struct("d1", "d2", "whole", "spans")).alias("marks")), "marks")
    joined = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("ord")).join(marks.hint("shuffle_hash"), "ord", "left").select("doc_id", "text", "marks")
    kind = docs.schema[key].dataType.simpleString()
    out = joined.mapInArrow(_cut(width, digest), f"c0 {kind}, c1 long, c2 long, c3 long, c4 {'string' if digest else 'binary'}")
    return out.toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, digest=True)
