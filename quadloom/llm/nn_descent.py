"""Embedding near-dedup by NN-descent.

1. Equal vectors are one class; only classes go on, as directions of 16-bit numbers. What such
   numbers can't decide (a cosine within their error of the threshold) is decided in double precision.
2. The graph starts poor: each class meets its neighbours in overlapping blocks of fixed size, in
   an order by hash, which keeps the graph connected, and in those of TREES random-projection
   trees, which saves rounds. A hot leaf is just more blocks.
3. NN-descent: each round, the neighbours of a class, and some of those whose neighbour it is,
   meet each other if one of them is new there; what is nearer than the last of a list enters
   it. Lists hold the nearest whatever their cosine, so that a vector without near ones goes on
   searching. A saturated list (all its entries are links) is doubled up to MOST_NEIGHBOURS and
   counts as new. Rounds end when one finds no link, enlarges no list and changes less than
   QUIET of all entries.
4. Links (cosine >= threshold) give components. A link between two lists saturated at the
   greatest length may be cut from both: where such lists lie in different components, their
   classes are compared with each other, block by block.
5. n_links is exact in components of one block; in larger ones it is what a list holds, unless the
   list is saturated: then the class is compared with its whole component, block by block.
6. Audit: up to AUDIT classes, chosen by hash, of each stratum (no component, a small one, a
   large one) are compared with all rows. While the mean recall of a stratum's classes that
   have links is below RECALL, another order by hash and more trees are added and the rounds go on.

Defined results: null, zero and non-finite vectors and those whose length isn't the table's
greatest link with nothing; equal vectors link (cosine 1); rows that repeat count each other;
a null vec_id is never a component's id unless it has no other; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm._common import components, drop, save

THRESHOLD = 0.95
TREES = 2
BITS = 40
BLOCK = 64
NEIGHBOURS = 12
REVERSE = 12
MOST_NEIGHBOURS = 128
QUIET = 0.03
AUDIT = 512
#: classes of a component that the audit takes as small
SMALL = 16
RECALL = 0.98
#: classes that a task compares with as many others; and the rows of a product at once
COUNT_BLOCK = 4096
ROWS = 512


def unit(column: pa.Array, dim: int) -> np.ndarray:
    v = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of huge or tiny numbers stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _code(dim: int):
    """(cid, v) -> (cid, q): directions as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(batch.column(1), dim)
            q = np.rint(u * (32767 / np.abs(u).max(axis=1, keepdims=True, initial=1e-9))).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in q], pa.binary())], ["cid", "q"])

    return run


def decoded(column: pa.Array, dim: int) -> np.ndarray:
    u = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, dim).astype(np.float64)
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def band(dim: int) -> float:
    """More than a cosine of coded directions can be wrong: each is off by half a step in every component."""
    return 2.5 * np.sqrt(dim) / 65534


def _signatures(dim: int, seeds: list[int]):
    """(cid, q) -> (tree, sig, cid, q): the sides of BITS hyperplanes of each tree as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng(s).standard_normal((dim, BITS)) for s in seeds]
        for batch in batches:
            u = decoded(batch.column(1), dim)
            for s, p in zip(seeds, planes):
                sig = ((u @ p > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), s)), pa.array(sig), *batch.columns], ["tree", "sig", "cid", "q"])

    return run


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k best of their a, each b once."""
    order = np.lexsort((-s, b, a))
    again = np.concatenate([[False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])]) if len(a) else np.zeros(0, bool)
    order = order[~again]
    order = order[np.lexsort((b[order], -s[order], a[order]))]
    first = np.concatenate([[True], a[order][1:] != a[order][:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[place < k]


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "s"])


def _blocks(dim: int, k: int):
    """Over (cid, q) in order: overlapping blocks; each class's k best of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = np.zeros(0, np.int64), np.zeros((0, dim))

        def work(i, u):
            sim = u @ u.T
            a, b = np.nonzero(i[:, None] != i[None, :])
            keep = _top(a, b, sim[a, b], k)
            return _edges(i[a[keep]], i[b[keep]], sim[a[keep], b[keep]])

        for batch in batches:
            ids, vecs = np.append(ids, np.asarray(batch.column(0))), np.vstack([vecs, decoded(batch.column(1), dim)])
            while len(ids) >= BLOCK:
                yield work(ids[:BLOCK], vecs[:BLOCK])
                ids, vecs = ids[BLOCK // 2 :], vecs[BLOCK // 2 :]
        if len(ids) > 1:
            yield work(ids, vecs)

    return run


def _groups(held: tuple | None, now: tuple) -> tuple[tuple, tuple | None]:
    """(rows of whole groups, rows of the group that may go on) of sorted rows whose first array is the key."""
    rows = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
    edge = np.flatnonzero(rows[0][1:] != rows[0][:-1])
    cut = int(edge[-1]) + 1 if len(edge) else 0
    return tuple(x[:cut] for x in rows), tuple(x[cut:] for x in rows)


def _join_locally(dim: int):
    """Over (a, b, fresh, q, k, worst) sorted by a: those b that meet at one a, one of them fresh, and are nearer than the worst of a list."""

    def work(rows):
        a, b, fresh, u, k, worst = rows
        edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
        sizes = np.diff(edge)
        by_size = np.argsort(sizes, kind="stable")  # groups of like size are compared together
        at = 0
        while at < len(by_size):
            few = max(1, (1 << 18) // int(sizes[by_size[min(at + 511, len(by_size) - 1)]]) ** 2)
            some = by_size[at : at + min(512, few)]
            at += len(some)
            m = int(sizes[some].max())
            pos = edge[:-1][some][:, None] + np.arange(m)
            there = np.arange(m) < sizes[some][:, None]
            pos = np.where(there, pos, 0)
            w = u[pos]
            sim = w @ w.transpose(0, 2, 1)
            new, ids = fresh[pos], b[pos]
            ok = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (sim > worst[pos][:, :, None])
            g, i, j = np.nonzero(ok)
            x, y, s, n = ids[g, i], ids[g, j], sim[g, i, j], k[pos][g, i]
            keep = _top(x, y, s, int(n.max(initial=1)))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep]), pa.array(s[keep]), pa.array(n[keep])], ["a", "b", "s", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                c = [np.asarray(batch.column(i)) for i in (0, 1, 2, 4, 5)]
                whole, held = _groups(held, (*c[:3], decoded(batch.column(3), dim), *c[3:]))
                if len(whole[0]):
                    yield from work(whole)
        if held is not None and len(held[0]):
            yield from work(held)

    return run


def _lists(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, s, fresh, k, grown): rows (a, b, s, old, k) cut to each class's list; a list full of links is doubled."""
    best = rows.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("old").alias("old"), F.max("k").alias("k"))
    own = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), "b", "old"))).alias("x"), F.max("k").alias("k"))
    own = own.withColumn("x", F.slice("x", 1, F.col("k")))
    full = (F.size("x") >= F.col("k")) & (-F.element_at("x", -1)["n"] >= threshold)
    own = own.withColumn("grown", full & (F.col("k") < MOST_NEIGHBOURS))
    own = own.withColumn("k", F.when(F.col("grown"), F.least(2 * F.col("k"), F.lit(MOST_NEIGHBOURS))).otherwise(F.col("k")))
    out = own.select("a", "k", "grown", F.explode("x").alias("x"))
    return out.select("a", "x.b", (-F.col("x.n")).alias("s"), (~F.col("x.old") | F.col("grown")).alias("fresh"), "k", "grown")


def _round(graph: DataFrame, coded: DataFrame, dim: int, threshold: float, number: int) -> DataFrame:
    """Neighbours of neighbours: the graph after one more round."""
    full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"), F.max("k").alias("k"))
    state = coded.join(full, coded["cid"] == full["a"], "left").select(F.col("cid").alias("b"), "q", F.coalesce("k", F.lit(NEIGHBOURS)).alias("k"), F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(-2.0).alias("worst"))
    # of those that have a class in their list, one per bucket of a hash that changes with the round
    other = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh", F.xxhash64("a", "b", F.lit(number)).alias("h"))
    other = other.groupBy("a", F.pmod("h", F.lit(REVERSE)).alias("bucket")).agg(F.min(F.struct("h", "b", "fresh")).alias("x")).select("a", "x.b", "x.fresh")
    entries = graph.select("a", "b", "fresh").union(other)
    active = entries.where("fresh").select("a").distinct()
    meet = entries.join(active, "a", "left_semi").join(state, "b").select("a", "b", "fresh", "q", "k", "worst")
    found = meet.repartition("a").sortWithinPartitions("a").mapInArrow(_join_locally(dim), "a long, b long, s double, k int")
    rows = graph.select("a", "b", "s", F.lit(True).alias("old"), "k").union(found.select("a", "b", "s", F.lit(False).alias("old"), "k"))
    return _lists(rows, threshold)


def descend(coded: DataFrame, graph: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, list[int]]:
    """Rounds until one changes next to nothing; the graph, and the links that it held before and after each round."""
    low = threshold - band(dim)
    graph = save(graph, "graph")
    links: list[int] = []
    for number in itertools.count():
        n, fresh, held, new, grown = graph.agg(F.count(F.lit(1)), *[F.count(F.when(c, 1)) for c in (F.col("fresh"), F.col("s") >= low, F.col("fresh") & (F.col("s") >= low), F.col("grown"))]).first()
        links.append(held)
        if number and not new and not grown and fresh <= QUIET * n or not n:
            return graph, links
        after = save(_round(graph, coded, dim, threshold, number), "graph")
        drop(graph)
        graph = after


def true_links(graph: DataFrame, base: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b), a < b, of the graph's edges whose cosine is at least the threshold; the doubtful ones in double precision."""
    edges = graph.where(F.col("s") >= threshold - band(dim)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))
    edges = save(edges, "edges")
    sure = F.col("s") >= threshold + band(dim)
    one, other = [base.select(F.col("cid").alias(k), F.col("v").alias(f"v{k}")) for k in ("a", "b")]
    doubt = edges.where(~sure).join(one, "a").join(other, "b").select("a", "b", "va", "vb")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link = pa.array((unit(batch.column(2), dim) * unit(batch.column(3), dim)).sum(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(link), batch.column(1).filter(link)], ["a", "b"])

    return save(edges.where(sure).select("a", "b").union(doubt.mapInArrow(decide, "a long, b long")), "links")


def _across(dim: int, threshold: float):
    """Over (pair, full, root, cid, v) sorted by pair: for each saturated class a link to each other component of its block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def work(rows):
            key, full, root, cid, u = rows
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            out = [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                x, y = lo + np.flatnonzero(full[lo:hi]), lo + np.flatnonzero(~full[lo:hi])
                i, j = np.nonzero((u[x] @ u[y].T >= threshold) & (root[x][:, None] != root[y][None, :]))
                if len(i):
                    first = np.unique(np.stack([cid[x][i], root[y][j]], axis=1), axis=0, return_index=True)[1]
                    out.append(np.stack([cid[x][i[first]], cid[y][j[first]]], axis=1))
            made = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

        for batch in batches:
            now = (*(np.asarray(batch.column(i)) for i in (0, 1, 2, 3)), unit(batch.column(4), dim))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            edge = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            if len(edge):
                yield work(tuple(x[: edge[-1]] for x in held))
                held = tuple(x[edge[-1] :] for x in held)
        if held is not None and len(held[0]):
            yield work(held)

    return run


def saturated(graph: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(cid): classes whose list has the greatest length and may hold nothing but links."""
    full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least"))
    return save(full.where((F.col("n") >= MOST_NEIGHBOURS) & (F.col("least") >= threshold - band(dim))).select(F.col("a").alias("cid")), "saturated")


def cut_links(base: DataFrame, full: DataFrame, roots: DataFrame, dim: int, threshold: float) -> DataFrame | None:
    """Edges (a, b) between components that lists at their greatest length may have cut.

    A list that isn't saturated holds the class's links, so a link that is in neither list is one
    between two saturated classes; those in one component need no more. None if there is no other.
    """
    rows = save(full.join(base, "cid").join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"), "v"), "full")
    n, kinds = rows.agg(F.count(F.lit(1)), F.countDistinct("root")).first()
    if kinds < 2:
        return None
    wide = -(-n // COUNT_BLOCK)
    own = F.pmod(F.xxhash64("cid"), F.lit(wide))
    each = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    a = rows.withColumn("i", own).withColumn("j", each).withColumn("full", F.lit(True))
    b = rows.withColumn("j", own).withColumn("i", each).withColumn("full", F.lit(False))
    met = a.unionByName(b).select((F.col("i").cast("long") * wide + F.col("j")).alias("pair"), "full", "root", "cid", "v")
    return save(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(_across(dim, threshold), "a long, b long"), "across")


def _count(dim: int, threshold: float):
    """Over (pair, asks, cid, n, v) sorted by pair: rows that each asking class links with, among those of its pair that don't ask."""

    def work(rows):
        key, asks, cid, n, u = rows
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        out, num = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge[:-1], edge[1:]):
            x, y = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(~asks[lo:hi])
            for i in range(0, len(x), ROWS):
                some = x[i : i + ROWS]
                link = (u[some] @ u[y].T >= threshold) & (cid[some][:, None] != cid[y][None, :])
                out.append(cid[some]), num.append((link @ n[y]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(num))], ["cid", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                whole, held = _groups(held, (*(np.asarray(batch.column(i)) for i in range(4)), unit(batch.column(4), dim)))
                if len(whole[0]):
                    yield work(whole)
        if held is not None and len(held[0]):
            yield work(held)

    return run


def link_counts(base: DataFrame, links: DataFrame, full: DataFrame, roots: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(cid, links): rows linked with each class that has a root."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / COUNT_BLOCK).cast("int"))
    placed = save(roots.join(sizes, "root").select(F.col("node").alias("cid"), "root", "blocks"), "placed")
    asking = placed.where("blocks = 1").select("cid").union(placed.where("blocks > 1").join(full, "cid", "left_semi").select("cid"))
    # lists of large components whose class has a list that isn't saturated
    both = links.union(links.select("b", "a")).join(placed.where("blocks > 1").select(F.col("cid").alias("a")), "a", "left_semi")
    held = both.join(full.select(F.col("cid").alias("a")), "a", "left_anti").join(base.select(F.col("cid").alias("b"), "n"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    members = base.select("cid", "n", "v").join(placed, "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = members.join(asking, "cid", "left_semi").withColumn("i", F.col("own")).withColumn("j", each).withColumn("asks", F.lit(True))
    told = members.join(asking.join(placed, "cid").select("root").distinct(), "root", "left_semi").withColumn("j", F.col("own")).withColumn("i", each).withColumn("asks", F.lit(False))
    # one number for (component, i, j); were two alike, pairs of different components would only be compared in vain
    pair = F.xxhash64("root", "i", "j")
    rows = asks.unionByName(told).select(pair.alias("pair"), "asks", "cid", "n", "v")
    counted = rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_count(dim, threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    return held.union(counted)


def _compare_all(dim: int, threshold: float, probes: np.ndarray, names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            cid, n, u = np.asarray(batch.column(0)), np.asarray(batch.column(1)), unit(batch.column(2), dim)
            link = (u @ probes.T >= threshold) & (cid[:, None] != names[None, :])
            total += n @ link
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["cid", "all"])

    return run


def audit(base: DataFrame, counts: DataFrame, roots: DataFrame, dim: int, threshold: float) -> float:
    """The least, over the strata, of the mean share of its links that a class of the sample (of fixed size) found."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    stratum = F.when(F.col("m").isNull(), 0).when(F.col("m") <= SMALL, 1).otherwise(2)
    placed = base.join(roots.join(sizes, "root"), F.col("cid") == F.col("node"), "left").select("cid", "v", stratum.alias("stratum"))
    rows = []
    for k in range(3):
        rows += placed.where(F.col("stratum") == k).orderBy(F.xxhash64("cid", F.lit(7)), "cid").limit(AUDIT).collect()
    if not rows:
        return 1.0
    probes = unit(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim)
    names = np.array([r["cid"] for r in rows])
    every = base.select("cid", "n", "v").mapInArrow(_compare_all(dim, threshold, probes, names), "cid long, all long").groupBy("cid").agg(F.sum("all").alias("all"))
    share = {r["cid"]: min(1.0, r["links"] / r["all"]) for r in every.where("all > 0").join(counts, "cid", "left").select("cid", "all", F.coalesce("links", F.lit(0)).alias("links")).collect()}
    # a class without a component and a link is no evidence; one lost link in a stratum must not drown in the others
    means = [np.mean(found) for k in range(3) if (found := [share[r["cid"]] for r in rows if r["stratum"] == k and r["cid"] in share])]
    return float(min(means, default=1.0))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row."""
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(~bad, F.lit(False)), F.col("v")))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None or dim < 1:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("recall"))
    rows = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    base = save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    coded = save(base.select("cid", "v").mapInArrow(_code(dim), "cid long, q binary"), "coded")
    graph = base.sparkSession.createDataFrame([], "a long, b long, s double, old boolean, k int")
    for round_ in itertools.count():
        placed = coded.mapInArrow(_signatures(dim, list(range(round_ * TREES, (round_ + 1) * TREES))), "tree long, sig long, cid long, q binary")
        placed = placed.union(coded.select(F.lit(-1).cast("long"), F.xxhash64("cid", F.lit(round_)), "cid", "q"))
        placed = placed.repartitionByRange("tree", "sig", "cid").sortWithinPartitions("tree", "sig", "cid").select("cid", "q")
        leaves = placed.mapInArrow(_blocks(dim, NEIGHBOURS), "a long, b long, s double")
        graph = graph.union(leaves.select("a", "b", "s", F.lit(False).alias("old"), F.lit(NEIGHBOURS).alias("k")))
        found, _ = descend(coded, _lists(graph, threshold), dim, threshold)
        links = true_links(found, base, dim, threshold)
        full = saturated(found, dim, threshold)
        roots = components(links, "embeddings")
        across = cut_links(base, full, roots, dim, threshold)
        if across is not None:
            roots = components(links.union(across), "embeddings")
        # a component's root is a member too
        roots = save(roots.union(roots.select("root", "root").distinct()), "roots")
        counts = save(link_counts(base, links, full, roots, dim, threshold), "counts")
        recall = audit(base, counts, roots, dim, threshold)
        if recall >= RECALL:
            break
        graph = found.select("a", "b", "s", F.lit(True).alias("old"), "k")
    placed = base.join(roots, base["cid"] == roots["node"], "left").select("cid", "v", "n", "least", F.coalesce("root", "cid").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    label = placed.join(least, "root").join(counts, "cid", "left").select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = rows.join(label, rows["v"] == label["w"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
