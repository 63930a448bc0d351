"""Minimum-cost-flow resharding: the fewest bytes move from old shards to new capacities.

1. Documents lie in blocks by a hash of their text, so equal texts share a block, whatever their
   number. `write_layout` puts the blocks of an old shard into files, each an equal range of them.
2. The sizes of the BLOCKS blocks, a table of fixed length, give the old shards' sizes. A
   minimum-cost flow from old shards to new ones (a byte that stays costs nothing) says how many
   bytes go where.
3. Blocks carry the flow, file by file, so that what leaves a shard fills few of its files. Then
   blocks of the same old shard, or blocks that move anyway, change places until each shard has
   its share; such exchanges cost no more than the bytes that were missing.
4. Only files that hold a moved block are rewritten. The others belong to the new layout as they are.

The law is `bytes`: sizes are near equal, up to the smallest blocks and unless the copies of a
single text are larger than a shard (copies stay together).

Defined results: a null text has size 1, CRC 0 and is a text of its own; rows that repeat are
separate rows of the same group; extra columns are carried to the files, but those named like
a column of the layout (block, old_shard, file, shard) are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm._common import gapless_rank, save

SHARDS = 8
OLD_SHARDS = 6
BLOCKS = 1 << 14
#: files of all old shards together, unless FILE_BYTES asks for more: equal ranges of blocks
FILES = 192
FILE_BYTES = 32 << 20


def block_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BLOCKS)).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def old_shard(block: np.ndarray, shards: int) -> np.ndarray:
    """The layout to start from: equal ranges of blocks."""
    return block * shards // BLOCKS


def file_of(block, shards: int):
    """The file of a block (array or column): files are ranges of blocks within one old shard."""
    each = FILES // shards
    if isinstance(block, Column):
        return F.expr(f"cast(block * {shards} div {BLOCKS} * {each} + (block * {shards} % {BLOCKS}) * {each} div {BLOCKS} as int)")
    return block * shards // BLOCKS * each + block * shards % BLOCKS * each // BLOCKS


def min_cost_flow(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Flow[i, j] of all supply to demand (equal totals) at the least cost: successive shortest paths."""
    n, m = len(supply), len(demand)
    flow, left, need = np.zeros((n, m), dtype=np.int64), np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    infinite = np.iinfo(np.int64).max // 4
    while left.any():
        # Bellman-Ford over old shards (0..n-1) and new ones (n..n+m-1), backwards along what flows
        dist, back = np.full(n + m, infinite), np.full(n + m, -1)
        dist[:n][left > 0] = 0
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] < infinite and dist[i] + cost[i, j] < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost[i, j], i, True
                    if flow[i, j] and dist[n + j] < infinite and dist[n + j] - cost[i, j] < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost[i, j], n + j, True
        ends = np.flatnonzero(need > 0)
        end = n + int(ends[np.argmin(dist[n + ends])])
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], need[end - n], *(flow[b, a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        need[end - n] -= amount
    return flow


def _even_out(sizes: np.ndarray, new: np.ndarray, load: np.ndarray, hi: int, lo: int, may: np.ndarray | None = None) -> bool:
    """Move a block from shard hi to lo, or exchange two, if that narrows their gap; whether it did. `may` marks the blocks that take part."""
    gap = load[hi] - load[lo]
    a, b = np.flatnonzero((new == hi) & (True if may is None else may)), np.flatnonzero((new == lo) & (True if may is None else may))
    if not len(a):
        return False
    give = np.sort(np.append(sizes[b], 0))
    # for each block of the large shard, the block (or none) to get back that brings the gap nearest to zero
    want = sizes[a] - gap / 2
    at = np.clip(np.searchsorted(give, want), 0, len(give) - 1)
    before = np.clip(at - 1, 0, len(give) - 1)
    at = np.where(np.abs(give[before] - want) < np.abs(give[at] - want), before, at)
    after = np.abs(gap - 2 * (sizes[a] - give[at]))
    k = int(np.argmin(after))
    if after[k] >= gap:
        return False
    x, y = a[k], give[at[k]]
    new[x] = lo
    if y:
        new[b[np.flatnonzero(sizes[b] == y)[0]]] = hi
    load[hi] -= sizes[x] - y
    load[lo] += sizes[x] - y
    return True


def _settle(sizes: np.ndarray, new: np.ndarray, load: np.ndarray, may: np.ndarray | None = None, slack: float = 1) -> None:
    """Exchange between the shards with most and least load, as long as a pair over `slack` apart improves."""
    improved = True
    while improved:  # the sum of squares falls strictly, so this ends
        order = np.argsort(-load, kind="stable")
        improved = any(_even_out(sizes, new, load, hi, lo, may) for hi in order for lo in order[::-1] if load[hi] - load[lo] > slack)


def capacities(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Equal parts of all bytes; a block larger than its part fills a shard alone and the others share the rest."""
    left, alone = int(sizes.sum()), []
    for n in sorted(map(int, sizes), reverse=True)[: shards - 1]:
        if n * (shards - len(alone)) <= left:
            break
        alone.append(n)
        left -= n
    rest = shards - len(alone)
    return np.array(alone + [left * (j + 1) // rest - left * j // rest for j in range(rest)])


def placed_capacities(sizes: np.ndarray, old: np.ndarray, shards: int) -> tuple[np.ndarray, dict[int, int]]:
    """The capacity of each shard: one that a single block fills is where that block lies, if it can be."""
    capacity = capacities(sizes, shards)
    alone = np.argsort(-sizes, kind="stable")[: int((capacity > capacity[-1] + 1).sum())]
    at_home: dict[int, int] = {}
    for k, b in enumerate(alone):
        if old[b] < shards:
            at_home.setdefault(int(old[b]), k)
    others = iter([k for k in range(shards) if k not in at_home.values()])
    return capacity[[at_home[j] if j in at_home else next(others) for j in range(shards)]], at_home


def assign(sizes: np.ndarray, old: np.ndarray, shards: int, file: np.ndarray | None = None) -> np.ndarray:
    """New shard of each block; `file` numbers the files that hold the blocks (each block by itself if not given)."""
    file = np.arange(len(sizes)) if file is None else file
    n_old = int(old.max()) + 1 if len(old) else 1
    supply = np.bincount(old, weights=sizes, minlength=n_old).astype(np.int64)
    capacity, _ = placed_capacities(sizes, old, shards)
    cost = 1 - np.eye(n_old, shards, dtype=np.int64)
    flow = min_cost_flow(supply, capacity, cost)
    new = np.zeros(len(sizes), dtype=np.int64)
    for i in range(n_old):
        own = np.flatnonzero(old == i)
        new[own] = _carry(sizes[own], flow[i].astype(np.float64), i, file[own])
    load = np.bincount(new, weights=sizes, minlength=shards)
    # blocks that move anyway may go to another shard at no cost, if that isn't the one they come from
    for hi in range(shards):
        for lo in range(shards):
            while load[hi] - load[lo] > 1 and _even_out(sizes, new, load, hi, lo, (new != old) & (old != hi) & (old != lo)):
                pass
    # blocks of one old shard change places at the cost of the difference of their sizes, within files that are rewritten anyway
    for i in range(n_old):
        _settle(sizes, new, load, (old == i) & np.isin(file, file[new != old]))
    # what is still uneven is worth moves beyond the fewest: first within an old shard, then any
    slack = max(1, load.mean() / 400_000)
    for i in range(n_old):
        _settle(sizes, new, load, old == i, slack)
    _settle(sizes, new, load, slack=slack)
    return new


def _carry(sizes: np.ndarray, due: np.ndarray, home: int, file: np.ndarray) -> np.ndarray:
    """Shards of an old shard's blocks (in the order of its files) whose sizes add up to what is due to each."""
    shards = len(due)
    used = [j for j in range(shards) if j == home or due[j] > 0]
    away = [j for j in used if j != home]
    new = np.full(len(sizes), home if home < shards else int(np.argmax(due)), dtype=np.int64)
    if not away or not len(sizes):
        return new
    left = due.copy()
    # blocks too large for the fine work go first, the largest to where most is due
    large = sizes * 4 > due[due * 100 > due.sum()].min()
    for b in sorted(np.flatnonzero(large), key=lambda b: (-sizes[b], b)):
        new[b] = int(np.argmax(left))
        left[new[b]] -= sizes[b]
    for b in np.flatnonzero(~large):  # then the first files, in turn to each shard that has most to come
        at = max(away, key=lambda j: left[j])
        if left[at] <= 0:
            break
        new[b] = at
        left[at] -= sizes[b]
    # within the files that are rewritten anyway, blocks change places until each shard gets what is due
    over = np.bincount(new, weights=sizes, minlength=shards) - due
    may = np.isin(file, file[new != home])
    improved = True
    while improved:
        order = sorted(used, key=lambda j: -over[j])
        improved = any(_even_out(sizes, new, over, hi, lo, may) for hi in order for lo in order[::-1] if over[hi] - over[lo] > 1)
    return new


@dataclass(frozen=True)
class Layout:
    """A layout on disk: rows with block, old_shard and file, one folder for each of the two."""

    files: DataFrame
    sizes: np.ndarray
    blocks: np.ndarray
    shards: int


def _salted(rows: DataFrame, bytes_of: dict[int, int], rest: list[str]) -> DataFrame:
    """rows brought together by file; a file of more than FILE_BYTES (a hot text's) is spread over several tasks."""
    spark = rows.sparkSession
    large = [(int(k), int(-(-n // FILE_BYTES))) for k, n in bytes_of.items() if n > FILE_BYTES]
    plain = [_column(c) for c in rest if "map<" not in rows.schema[c].dataType.simpleString()]
    salt = F.lit(0)
    if large:  # at most FILES rows
        rows = rows.join(F.broadcast(spark.createDataFrame(large, "file int, parts int")), "file", "left")
        salt = F.pmod(F.xxhash64(*plain), F.coalesce("parts", F.lit(1)))
    return rows.repartition("file", salt).drop("parts")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def write_layout(docs: DataFrame, text: str = "text", shards: int = OLD_SHARDS) -> Layout:
    """docs written as the shards to start from."""
    rest = [c for c in docs.columns if c.lower() not in ("block", "old_shard", "file", "shard")]
    rows = docs.select(*[_column(c) for c in rest], block_of(_column(text)).alias("block"))
    rows = rows.withColumn("file", file_of(F.col("block"), shards)).withColumn("old_shard", F.expr(f"cast(block * {shards} div {BLOCKS} as int)"))
    found = rows.groupBy("block").agg(F.sum(size_of(_column(text))).alias("size")).collect()  # BLOCKS rows at most
    table = np.array(sorted((r["block"], r["size"]) for r in found), dtype=np.int64).reshape(-1, 2)
    of = file_of(table[:, 0], shards)
    bytes_of = {int(k): int(table[of == k, 1].sum()) for k in np.unique(of)}
    files = save(_salted(rows, bytes_of, rest), "layout", ["old_shard", "file"])
    return Layout(files, table[:, 1], table[:, 0], shards)


@dataclass(frozen=True)
class Moves:
    """What resharding did: new shard of each block, bytes moved, the fewest that the flow allows, and files rewritten of all."""

    shard: np.ndarray
    moved: int
    fewest: int
    rewritten: int
    files: int


def reshard(layout: Layout, shards: int = SHARDS) -> tuple[DataFrame, Moves]:
    """The new layout (rows with block and shard) and what it took: rewritten files beside the old ones that stay."""
    old = old_shard(layout.blocks, layout.shards)
    of = file_of(layout.blocks, layout.shards)
    new = assign(layout.sizes, old, shards, of)
    gone = np.unique(of[new != old])
    fewest = int(layout.sizes.sum()) - int(np.minimum(*_totals(layout.sizes, old, shards)).sum())
    moves = Moves(new, int(layout.sizes[new != old].sum()), fewest, len(gone), len(np.unique(of)))
    own = [c for c in layout.files.columns if c not in ("block", "old_shard", "file")]
    columns = [*map(_column, own), "block", "shard"]
    if not len(gone):
        return layout.files.withColumn("shard", F.col("old_shard")).select(*columns), moves
    hit = F.col("file").isin(gone.tolist())  # at most FILES numbers; file is a folder, so the scan reads no other
    where = layout.files.sparkSession.createDataFrame([(int(b), int(j)) for b, j in zip(layout.blocks, new)], "block int, shard int")
    rows = layout.files.where(hit).join(F.broadcast(where), "block")  # BLOCKS rows
    touched = np.isin(of, gone)
    # a new file holds what one old file sends to one shard
    rows = rows.withColumn("file", F.col("file") * shards + F.col("shard"))
    key = of * shards + new
    bytes_of = {int(k): int(layout.sizes[touched & (key == k)].sum()) for k in np.unique(key[touched])}
    written = save(_salted(rows.select(*columns, "file"), bytes_of, own), "reshard", ["shard", "file"])
    stays = layout.files.where(~hit).withColumn("shard", F.col("old_shard")).select(*columns)
    return stays.unionByName(written.select(*columns)), moves


def _totals(sizes: np.ndarray, old: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each new shard has from before, and its capacity."""
    have = np.bincount(old, weights=sizes, minlength=shards).astype(np.int64)
    capacity, _ = placed_capacities(sizes, old, shards)
    return have[:shards], capacity


def op8_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files, _ = reshard(write_layout(docs))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = files.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"))
    ranked = gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", "slots")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
