"""SimHash near-duplicates, linked through the anchors of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits agree in one of their 32-bit halves up
to one bit. Each half is covered by a code: the Hamming code of length 31 (every word lies
within one bit of exactly one codeword) with the last bit free, so the covering radius is 1.
A fingerprint's home is the nearest codeword of each half; it also visits every anchor within
radius 1 plus threshold 1, at most 17 per half. Two linked fingerprints then meet at the home
of either: that is where they are compared, in full.

Equal fingerprints are collapsed first, so copies cost nothing. An anchor with many
fingerprints is cut into slices, and each pair of slices is a task of its own. An anchor hands on a forest of its
links (at most one edge per fingerprint), enough for components; no pairs are listed.

Defined results: a null or wordless text has fingerprint zero and is linked like any other;
repeated rows have equal fingerprints and one component; component_id is the smallest doc_id
that is not null (null only where a component has no other); other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm._common import components, save

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Fingerprints of one anchor in a slice; a task compares the homes of one slice with one slice.
SLICE = 4096


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `size` words, A-Z lower-cased, joined by one space; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    end = list(accumulate(map((1).__add__, map(len, words))))
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *end], end[size - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            made = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"", size)) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), batch.column(2)], ["doc_id", "fp", "tag"])

    return run


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Xor of the places (1 to 31) of the set bits among the first 31: zero for a codeword."""
    out = np.zeros_like(half)
    for place in range(1, 32):
        out ^= np.where((half >> np.uint64(place - 1)) & np.uint64(1), np.uint64(place), np.uint64(0))
    return out


def _flip(half: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Flip bit `place` (1 to 32; 0: none)."""
    return half ^ np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def home(half: np.ndarray) -> np.ndarray:
    """The codeword within one bit."""
    return _flip(half, _syndromes(half))


def anchors(half: np.ndarray) -> np.ndarray:
    """All codewords within two bits of each word: an array of 17 columns, some of them equal."""
    s = _syndromes(half)
    near = _flip(half, s)
    columns = [near, near ^ np.uint64(1 << 31)]  # the free bit costs one flip
    for place in range(1, 32):
        other = s ^ np.uint64(place)
        # two flips among the 31 whose places xor to the syndrome; each pair once
        use = (s != 0) & (other > np.uint64(place))
        columns.append(np.where(use, _flip(_flip(half, np.full_like(half, place)), other), near))
    return np.stack(columns, axis=1)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, is home, fingerprint): each fingerprint once per half at home, and once at each other anchor near it."""
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for lo in range(0, len(fps), 8192):
            fp = fps[lo : lo + 8192]
            for which in (0, 1):
                half = (fp >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)
                near = np.sort(anchors(half), axis=1)
                own = home(half)[:, None]
                first = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                row, col = np.nonzero(first)
                at = near[row, col]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at | np.uint64(which << 32)).view(np.int64)), pa.array(at == own[row, 0]), pa.array(fp[row].view(np.int64))], ["anchor", "home", "fp"]
                )


def _forest(links: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most size - 1 edges that connect what the links connect."""
    label = np.arange(size)
    while True:
        new = label.copy()
        for u, v in links:
            low = np.minimum(new[u], new[v])
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def compare(fps: np.ndarray, homes: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Forest (places) of the links between the homes and all fingerprints of one anchor, block by block."""
    links = []
    at_home = np.flatnonzero(homes)
    for lo in range(0, len(at_home), 512):
        h = at_home[lo : lo + 512]
        for lo2 in range(0, len(fps), 1 << 13):
            block = fps[lo2 : lo2 + (1 << 13)]
            i, j = np.nonzero(np.bitwise_count(fps[h][:, None] ^ block[None, :]) <= threshold)
            u, v = h[i], j + lo2
            keep = u != v
            if keep.any():
                # what one block links is contracted at once, so that a dense anchor stays small
                u, v = u[keep], v[keep]
                places, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
                a, b = _forest([(inv[: len(u)], inv[len(u) :])], len(places))
                links.append((places[a], places[b]))
    return _forest(links, len(fps)) if links else (np.zeros(0, int), np.zeros(0, int))


def _links(threshold: int):
    """Over rows sorted by (anchor, pair of slices): compare each group; a group's rows come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(keys, fps, homes):
            edge = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            size = np.diff(edge)
            out_a, out_b = [], []
            # groups of two, by far the most, are compared all at once
            two = edge[:-1][size == 2]
            close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= threshold
            close &= homes[two] | homes[two + 1]
            out_a.append(fps[two][close]), out_b.append(fps[two + 1][close])
            for k in np.flatnonzero(size > 2):
                lo, hi = edge[k], edge[k + 1]
                if homes[lo:hi].any():
                    u, v = compare(fps[lo:hi], homes[lo:hi], threshold)
                    out_a.append(fps[lo:hi][u]), out_b.append(fps[lo:hi][v])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            fps, homes = np.asarray(batch.column(2)).view(np.uint64), np.asarray(batch.column(3))
            if not len(keys):
                continue
            # all but the last group are whole
            differs = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if held and cut == 0 and (held[0][0][0] != keys[0]).any():
                yield work(*[np.concatenate(x) for x in zip(*held)])
                held = []
            if cut:
                held.append((keys[:cut], fps[:cut], homes[:cut]))
                yield work(*[np.concatenate(x) for x in zip(*held)])
                held = []
            held.append((keys[cut:], fps[cut:], homes[cut:]))
        if held:
            yield work(*[np.concatenate(x) for x in zip(*held)])

    return run


def link_fingerprints(fps: DataFrame, threshold: int = THRESHOLD, slice_size: int = SLICE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within `threshold` bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves with radius 1 find links of at most 3 bits")
    rows = save(fps.select("fp").mapInArrow(_replicas, "anchor long, home boolean, fp long"), "anchors")
    # only anchors with a home and another fingerprint can link
    busy = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    busy = busy.where("n > 1 and h > 0").select("anchor", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))
    met = rows.join(busy, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    # pair (i, j) of slices compares the homes of slice i with all of slice j: no task holds a whole hot anchor
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    visits = F.transform(others, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), (F.col("home") & (i == F.col("own"))).alias("home")))
    stays = F.transform(F.filter(others, lambda j: F.col("home") & (j != F.col("own"))), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("home")))
    spread = met.select("anchor", "fp", F.explode(F.when(F.col("slices") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home")))).otherwise(F.concat(visits, stays))).alias("x"))
    spread = spread.select("anchor", F.shiftleft(F.col("x.i").cast("long"), 32).bitwiseOR(F.col("x.j").cast("long")).alias("pair"), "fp", "x.home")
    return spread.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair").mapInArrow(_links(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, tag, component_id) of every row of docs; tag is a hash of the text, to tell apart rows that share a doc_id."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("tag"))
    prints = save(source.mapInArrow(_fingerprints(shingle), "doc_id long, fp long, tag long"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(classes, threshold), "simhash")
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = placed.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "tag", "component_id")


def one_each(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component of groups (doc_id, fp, tag, component_id) the one with the smallest doc_id, once."""
    last = F.lit((1 << 63) - 1)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.select(F.coalesce("doc_id", last).alias("_ord"), F.col("component_id").alias("_c"), F.col("fp").alias("_fp"), F.col("tag").alias("_tag"))
    # of rows that share the smallest doc_id, one; of components without any doc_id, one per fingerprint
    stays = stays.groupBy("_ord", F.when(F.col("_c").isNull(), F.col("_fp")).alias("_g")).agg(F.min("_tag").alias("_tag")).select("_ord", "_tag").distinct()
    # the row goes as a whole, so no name of its columns matters
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    whole = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(whole.alias("_row"), F.coalesce(column(key).cast("long"), last).alias("_ord"), F.xxhash64(column(text)).alias("_tag"))
    rows = rows.join(stays, ["_ord", "_tag"], "left_semi")
    again = Window.partitionBy("_ord", "_tag").orderBy(F.lit(0))
    rows = rows.withColumn("_n", F.row_number().over(again)).where("_n = 1")
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, once."""
    return one_each(docs, near_duplicates(docs, key, text, shingle, threshold), key, text)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
