"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Fingerprints can't reach 0.8: such texts differ in up to 17 of 64 bits. They only give early links
here; what is linked follows from the shingles.

1. Texts of equal shingle sets are one class; only classes go on.
2. Prefix filter: with the shingles of every set in one global order, two sets of similarity t or
   more share one of the first n - ceil(t n) + 1 of each. The order puts shingles that are frequent
   in a sample last; it decides the cost alone, any order gives all pairs.
3. Candidates are first bounded by their prefixes alone: of two sets, the one whose prefix ends
   first has all its common shingles up to there in the other's prefix, and at most the rest of
   it in common beyond. This exact bound drops texts that only share a passage.
4. What is left is checked on the whole sets, which are read for these texts only. First the
   SimHash links and one pivot per shingle, so that dense groups become components at once; then,
   while shingles are left whose pairs across components are many for their rows, a few pivots
   of other orders each; then all pairs that lie in different components.
5. Pairs may grow with the square of a group. They are only ever listed, bounded and checked as
   many at a time as there are classes, and what one part links is left out of the next:
   the disk holds a multiple of the classes, however many pairs there are.

Defined results: a null or wordless text has the empty set and is linked with its like; a text of
fewer words than a shingle is one shingle; component_id is the smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._common import components, drop, save
from quadloom.llm.simhash_anchors import fingerprint, link_fingerprints, one_each, shingle_hashes

SHINGLE = 5
#: least Jaccard similarity of a link, as a fraction
SIMILARITY = (4, 5)
#: texts of the sample that orders the shingles, and how many of its frequent shingles come last
SAMPLE = 8192
FREQUENT = 1 << 18
#: one text in so many is in the sample at least, so that the order is as good for larger tables
SHARE = 24
#: pairs joined with their prefixes at a time: as many as classes, but at least so many; with whole sets, an eighth of them
LEAST_PAIRS = 1 << 16
#: places where pairs meet, repeats included, in a part of the last step: so many for each pair of the above
MEETINGS = 64
#: pivots a shingle gets at a time, and how often at most; only one with many more pairs for each of its rows
PIVOTS = 4
TURNS = 8


def shingle_set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, dtype=np.uint64))


def prefix_length(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    num, den = similarity
    return n - -(-n * num // den) + 1 if n else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(size: int):
    """(tag, text) -> (tag, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                made = _lists([shingle_set(shingle_hashes(t.as_py() or b"", size)) for t in part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], made], ["tag", "shingles"])

    return run


def _sketches(size: int, similarity: tuple[int, int], often: np.ndarray, count: np.ndarray):
    """(doc_id, text, tag) -> the class, fingerprint, size and prefix of each text, and the place of the prefix's end in the order."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, fps, sizes, prefixes, ranks, ends = [], [], [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", size)
                own = shingle_set(hashes)
                cids.append(xxh3_64_intdigest(own.tobytes()))
                fps.append(fingerprint(hashes))
                sizes.append(len(own))
                rank = np.zeros(len(own), dtype=np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    rank = np.where(often[at] == own, count[at], 0)
                    order = np.lexsort((own, rank))
                    own, rank = own[order], rank[order]
                p = prefix_length(len(own), similarity)
                prefixes.append(own[:p])
                ranks.append(int(rank[p - 1]) if p else 0)
                ends.append(int(own[p - 1]) ^ (1 << 63) if p else 0)  # signed numbers in the order of unsigned ones
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (cids, fps, ends)]
            columns = [batch.column(0), batch.column(2), *signed[:2], pa.array(sizes, pa.int64()), _lists(prefixes), pa.array(ranks, pa.int64()), signed[2]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "cid", "fp", "n", "prefix", "rank", "end"])

    return run


def _frequent(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, and their counts."""
    share = max(1, min(source.count() // SAMPLE, SHARE))
    some = source.where(F.pmod("tag", F.lit(share)) == 0).select("tag", "t").mapInArrow(_sets(size), "tag long, shingles array<long>")
    rows = some.select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    keys, count = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], count[order]


def _parts(df: DataFrame, most: int, *by: str) -> list[DataFrame]:
    """A saved table in parts of about `most` rows, by a hash of some columns."""
    k = -(-df.count() // most)
    return [df.where(F.pmod(F.xxhash64(*by), F.lit(k)) == i) for i in range(k)] if k > 1 else [df]


def _bounded(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that their prefixes allow to be similar enough."""
    num, den = similarity
    one, other = [classes.select(F.col("cid").alias(k), F.struct("n", "prefix", "rank", "end").alias(f"x{k}")) for k in ("a", "b")]
    met = pairs.join(one, "a").join(other, "b")
    n, m = F.col("xa.n"), F.col("xb.n")
    a_ends_first = F.struct("xa.rank", "xa.end") <= F.struct("xb.rank", "xb.end")
    beyond = F.when(a_ends_first, n - F.size("xa.prefix")).otherwise(m - F.size("xb.prefix"))
    most = F.least(F.size(F.array_intersect("xa.prefix", "xb.prefix")) + beyond, n, m)
    return met.where(most * (num + den) >= (n + m) * num).select("a", "b")


def _sets_of(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(cid, shingles) of the classes in pairs, made anew from the texts."""
    need = save(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", "tag"), "needed")
    # rows of equal texts share a tag: one of them is enough
    own = source.join(need, "tag", "left_semi").select("tag", "t").mapInArrow(_sets(size), "tag long, shingles array<long>")
    sets = save(own.groupBy("tag").agg(F.any_value("shingles").alias("shingles")).join(need, "tag").select("cid", "shingles"), "sets")
    drop(need)
    return sets


def _checked(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, similarity: tuple[int, int], most: int) -> list[DataFrame]:
    """The pairs (a, b) whose sets are similar enough; about `most` are joined with their sets at a time."""
    num, den = similarity
    # many pairs of few classes share one table of sets; else each part has its own, of two classes a pair at most
    shared = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().count() <= 2 * most
    sets, links = _sets_of(pairs, classes, source, size) if shared else None, []
    for part in _parts(pairs, most, "a", "b"):
        of = sets if shared else _sets_of(part, classes, source, size)
        one, other = [of.select(F.col("cid").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b")]
        met = part.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        # common / (n + m - common) >= num / den
        links.append(save(met.where(F.col("common") * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b"), "links"))
        if not shared:
            drop(of)
    if shared:
        drop(sets)
    return links


def _verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, similarity: tuple[int, int], most: int) -> DataFrame:
    """The distinct pairs (a, b) that are similar enough; about `most` are joined with prefixes at a time, and an eighth of that with sets."""
    pairs = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    links = []
    for part in _parts(pairs, most, "a", "b"):
        near = save(_bounded(part, classes, similarity), "candidates")
        links += _checked(near, classes, source, size, similarity, max(1, most // 8))
        drop(near)
    drop(pairs)
    if len(links) == 1:
        return links[0]
    whole = save(reduce(DataFrame.union, links), "links")
    for done in links:
        drop(done)
    return whole


def _possible(similarity: tuple[int, int]):
    """Whether (n, pos) and (m, place) of a common shingle leave room for enough common ones, were it the first."""
    num, den = similarity
    n, m = F.col("n"), F.col("m")
    most = F.least(n - F.col("pos"), m - F.col("place"))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most * (num + den) >= (n + m) * num)


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows whose shingle is found in several components, with their component, the number of the shingle's rows and of its pairs across components."""
    placed = rows.join(roots, F.col("cid") == F.col("node"), "left").select("h", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"))
    own = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
    across = own.groupBy("h").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("within"))
    across = across.select("h", "rows", ((F.col("rows") * F.col("rows") - F.col("within")) / 2).alias("pairs")).where("pairs > 0")
    return save(placed.join(across, "h"), "open")


def _pivots(rows: DataFrame, turn: int, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each class with the shingle's classes that come first in some orders, where the components differ."""
    first = [F.min(F.struct(F.xxhash64("cid", F.lit(turn * PIVOTS + i)).alias("by"), "cid", "n", "pos", "root")) for i in range(PIVOTS)]
    pivot = rows.groupBy("h").agg(F.array(*first).alias("p")).select("h", F.explode("p").alias("p"))
    pivot = pivot.select("h", F.col("p.cid").alias("b"), F.col("p.n").alias("m"), F.col("p.pos").alias("place"), F.col("p.root").alias("r"))
    return rows.join(pivot, "h").where((F.col("root") != F.col("r")) & _possible(similarity)).select(F.col("cid").alias("a"), "b")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, fp, tag, component_id) of every row of docs, as simhash_anchors.near_duplicates has it; fp names the component."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("tag"))
    sketch = _sketches(shingle, similarity, *_frequent(source, shingle))
    prints = save(source.mapInArrow(sketch, "doc_id long, tag long, cid long, fp long, n long, prefix array<long>, rank long, end long"), "sketches")
    same = [F.any_value(c).alias(c) for c in ("n", "prefix", "rank", "end")]
    classes = save(prints.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("tag").alias("tag"), F.min("fp").alias("fp"), *same), "classes")
    rows = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "h"))
    busy = rows.groupBy("h").count().where("count > 1").select("h")
    rows = save(rows.join(busy, "h"), "prefixes")
    pick = classes.groupBy("fp").agg(F.min("cid").alias("first"))
    near = link_fingerprints(pick.select("fp"))
    a, b = [pick.select(F.col("fp").alias(k), F.col("first").alias(f"c{k}")) for k in ("a", "b")]
    early = near.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    early = early.union(classes.join(pick, "fp").select(F.col("cid").alias("a"), F.col("first").alias("b")))
    pivot = rows.groupBy("h").agg(F.min(F.struct("cid", "n", "pos")).alias("p")).select("h", F.col("p.cid").alias("b"), F.col("p.n").alias("m"), F.col("p.pos").alias("place"))
    star = rows.join(pivot, "h").where(_possible(similarity)).select(F.col("cid").alias("a"), "b")
    most = max(LEAST_PAIRS, classes.count())
    links = _verified(early.union(star), classes, source, shingle, similarity, most)

    roots = components(links, "similar")
    placed, before = _open(rows, roots), None
    meetings = F.coalesce(F.sum(F.col("pairs") / F.col("rows")), F.lit(0.0))
    for turn in range(TURNS):
        dense = placed.where(F.col("pairs") > 4 * PIVOTS * F.col("rows"))
        now = dense.agg(meetings).first()[0]
        # where texts only share passages, pivots link nothing
        if not now or before is not None and 4 * now > 3 * before:
            break
        links = links.union(_verified(_pivots(dense, turn, similarity), classes, source, shingle, similarity, most))
        roots, done, before = components(links, "similar"), placed, now
        placed = _open(rows, roots)
        drop(done)
    parts = max(1, int(-(-placed.agg(meetings).first()[0] // (MEETINGS * most))))
    for i in range(parts):
        if i:
            done, placed = placed, _open(rows, roots)
            drop(done)
        other = placed.select("h", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("place"), F.col("root").alias("r"))
        own = placed.where(F.pmod(F.xxhash64("cid"), F.lit(parts)) == i)
        rest = own.join(other, "h").where((F.col("root") != F.col("r")) & (F.col("cid") < F.col("b")) & _possible(similarity))
        links = links.union(_verified(rest.select(F.col("cid").alias("a"), "b"), classes, source, shingle, similarity, most))
        roots = components(links, "similar")
    drop(placed)

    label = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = label.join(least, "root").select("cid", "root", "component_id")
    return prints.select("doc_id", "tag", "cid").join(label, "cid").select("doc_id", F.col("root").alias("fp"), "tag", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, once."""
    return one_each(docs, similar_texts(docs, key, text, shingle, similarity), key, text)
