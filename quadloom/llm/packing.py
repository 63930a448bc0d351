"""Best-fit packing of token pieces, improved by swap-based local search.

Lengths are whole numbers up to the capacity, so the pieces to pack are a histogram of at most
1024 counts, whatever the number of documents. The plan is made on that: best fit decreasing
opens bins by pattern (a multiset of lengths, with how many bins have it); then underfull
patterns exchange one for one, two for one, or move a length, whenever that raises the squared
fill, until bins empty or no exchange helps. The plan goes to the executors as a table of
(length, ranks) -> (bins, offset); a piece's rank among those of its length, found without
holding a length in one task, tells its place. The token ids never leave the task that made
them, but for the real sequences in `sequences`.

Defined results: null text is empty: one piece that holds the end id alone. Rows that repeat
are separate documents; extra columns are ignored; an empty table gives an empty table. A
document longer than the capacity is cut; its first piece takes what the whole ones leave over.
Bytes that aren't UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm._common import gapless_rank, save
from quadloom.llm._hashing import slices
from quadloom.llm.tokenizing import ByteBPE

CAPACITY = 1024
END_ID = 2

_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids, and n."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            # a string column may hold bytes that aren't UTF-8: they are read as U+FFFD
            texts = [t and t.decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in slices([len(t or "") for t in texts]):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for i in range(lo, hi):
                    ids = np.array([*bpe.encode(texts[i] or ""), end_id], dtype="<u4")
                    cuts = cut_points(len(ids), capacity)
                    for k in range(len(cuts) - 1):
                        own = ids[cuts[k] : cuts[k + 1]]
                        rows.append(i), piece.append(k), start.append(cuts[k]), length.append(len(own)), crc.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Bins:
    """Patterns of bins: a sorted tuple of lengths -> number of bins with just these."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: dict[tuple[int, ...], int] = {}

    def add(self, pattern: tuple[int, ...], n: int) -> None:
        left = self.count.get(pattern, 0) + n
        if left:
            self.count[pattern] = left
        else:
            self.count.pop(pattern, None)

    def total(self) -> int:
        return sum(n for p, n in self.count.items() if p)


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Bins:
    """Longest first, each into the fullest bin that still holds it; equal bins are filled together."""
    bins = Bins(capacity)
    room: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> open patterns
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = capacity // length
                n, rest = divmod(left, each)
                for k, times in ((each, n), (rest, 1)):
                    if k and times:
                        room.setdefault(capacity - k * length, {}).setdefault((length,) * k, 0)
                        room[capacity - k * length][(length,) * k] += times
                break
            pattern, n = next(iter(room[fit].items()))
            # the same bin stays the fullest that fits until its room is used
            each = min(fit // length, left)
            used = min(n, left // each)
            room[fit][pattern] -= used
            if not room[fit][pattern]:
                del room[fit][pattern]
            if not room[fit]:
                del room[fit]
            grown = pattern + (length,) * each
            to = room.setdefault(fit - each * length, {})
            to[grown] = to.get(grown, 0) + used
            left -= used * each
    for patterns in room.values():
        for p, n in patterns.items():
            bins.add(tuple(sorted(p)), n)
    return bins


def _without(pattern: tuple[int, ...], *items: int) -> tuple[int, ...]:
    left = list(pattern)
    for x in items:
        left.remove(x)
    return tuple(left)


def _exchange(a: tuple[int, ...], b: tuple[int, ...], free: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """(new a, new b): the move or swap that adds most to b, at most its free room."""
    best, found = 0, None
    kinds_a, kinds_b = sorted(set(a)), sorted(set(b))
    for x in kinds_a:
        if best < x <= free:  # move
            best, found = x, ((x,), ())
        for y in kinds_b:  # one for one
            if best < x - y <= free:
                best, found = x - y, ((x,), (y,))
    for i, x in enumerate(kinds_a):  # two for one
        for z in kinds_a[i:]:
            if x == z and a.count(x) < 2:
                continue
            for y in kinds_b:
                if best < x + z - y <= free:
                    best, found = x + z - y, ((x, z), (y,))
    if found is None:
        return None
    out, back = found
    return tuple(sorted(_without(a, *out) + back)), tuple(sorted(_without(b, *back) + out))


def local_search(bins: Bins) -> int:
    """Exchange between underfull patterns, the emptiest first, while the squared fill rises; returns the exchanges made.

    Stops at the lower bound of bins or when no pair of patterns has an exchange that helps: what
    goes from one bin to the other exceeds the fill that it is behind. The sum of squares rises
    with every exchange, so this ends. An exchange is one of whole patterns, and a pair that had
    none isn't looked at again, so the work follows the variety of lengths, not the rows.
    """
    c = bins.capacity
    least = -(-sum(sum(p) * n for p, n in bins.count.items()) // c)
    made, barren = 0, set()
    while bins.total() > least:
        under = sorted((p for p in bins.count if p and sum(p) < c), key=lambda p: (sum(p), p))
        moved = False
        for giver in under:
            for taker in reversed(under):
                if (giver, taker) in barren or (taker == giver and bins.count[giver] < 2):
                    continue
                new = _exchange(giver, taker, c - sum(taker))
                if new is None or sum(giver) - sum(new[0]) <= sum(giver) - sum(taker):
                    barren.add((giver, taker))
                    continue
                n = bins.count[giver] // 2 if giver == taker else min(bins.count[giver], bins.count[taker])
                for old, made_of in ((giver, new[0]), (taker, new[1])):
                    bins.add(old, -n)
                    bins.add(made_of, n) if made_of else None
                made, moved = made + 1, True
                break
            if moved:
                break
        if not moved:
            break
    return made


@dataclass(frozen=True)
class Report:
    """Bins before and after the search, the least number that the lengths' sum allows, and the exchanges made."""

    before: int
    after: int
    bound: int
    exchanges: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Bins, Report]:
    bins = best_fit_decreasing(histogram, capacity)
    before = bins.total()
    made = local_search(bins)
    return bins, Report(before, bins.total(), -(-sum(k * n for k, n in histogram.items()) // capacity), made)


def slots(bins: Bins) -> dict[str, np.ndarray]:
    """Per length, runs of ranks: rank r in [first, first + n) goes to sequence base + r - first at offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern in sorted(bins.count, reverse=True):
        n, offset = bins.count[pattern], 0
        for length in reversed(pattern):
            first = taken.get(length, 0)
            rows.append((length, first, base, offset))
            taken[length] = first + n
            offset += length
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def _place(table: dict[str, np.ndarray]):
    key = (table["length"] << 48) | table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(batch.num_columns - 2)), np.asarray(batch.column(batch.num_columns - 1))
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 2)], pa.array(table["base"][at] + rank - table["first"][at]), pa.array(table["offset"][at])],
                [*batch.schema.names[:-2], "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of every piece.

    `tokenizer` is the path of a byte-level BPE in the format of the `tokenizers` library, the same on all executors.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    made = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)
    made = save(made, "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity)[0])
    ranked = gapless_rank(made, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_rank", "ranked")
    names = [c for c in made.columns]
    return ranked.select(*names, F.col("length").alias("_length"), "_rank").mapInArrow(_place(table), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pack(..., with_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer())
