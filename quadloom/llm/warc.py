"""WARC archives and their capture index, merged externally by a loser tree.

`write` puts a record per page into gzip-per-record WARC 1.1 files in the shared folder;
`read` parses such files again, checks every digest and gives one index row per record. Each
reading task sorts its rows: a capture run. `merge` brings the runs into one global order by
(URL key, timestamp, page_id): key ranges from a bounded sample of the runs are tasks, and each
merges its part of every run through a loser tree, at most FAN_IN runs at a time. More runs are
merged in passes, each one job whose tasks are the groups of runs times the key ranges, so a
pass has at least as many tasks as ranges. At most MOST_RUNS runs are made: where there are more
archives, a task reads several and sorts them together. No task holds more than a batch of each run.

A page whose payload equals that of a page with a smaller page_id is a revisit record without
payload. Defined results: null html is an empty payload; a null URL has no target and key '';
a null page_id counts as larger than any and its record id is the payload's; rows that repeat
(same page_id and payload) are written each, and are responses where their id is the smallest;
bytes of a payload are kept as they are, those of a URL that aren't UTF-8 are read as U+FFFD; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm._common import save, workspace

FILE_BYTES = 64 << 20
FAN_IN = 64
MOST_RUNS = 1 << 14
SAMPLE = 2048
LAST = (1 << 63) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = 0x71756164_6C6F6F6D
EPOCH = 1_700_000_000
INDEX = "urlkey string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"

NAMES = [x.split()[0] for x in INDEX.split(", ")]


def record_id(page_id: int | None, digest: bytes) -> str:
    number = (SPACE << 64) | (page_id & ((1 << 64) - 1)) if page_id is not None else int.from_bytes(digest[:16], "big") & ~(1 << 127)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier[10:-1]).int
    if number >> 64 != SPACE:
        return None
    low = number & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def url_key(url: str | None) -> str:
    """Sortable form: host labels reversed, then the path, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
    except ValueError:
        return url.lower()
    host = (parts.netloc.rpartition("@")[2]).partition(":")[0]
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, seconds: int, refers_to: int | None, revisit: bool) -> bytes:
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    """(page_id, url, html, ts, first) -> (file): archives of this task; names hold the attempt, so a retry never clashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        out, files, size = None, [], 0
        for batch in batches:
            urls = [u and u.decode("utf-8", "replace") for u in batch.column(1).cast(pa.binary()).to_pylist()]
            for page, url, html, ts, first in zip(batch.column(0).to_pylist(), urls, *(c.to_pylist() for c in batch.columns[2:])):
                if out is None:
                    name = f"capture-{uuid.uuid4().hex}.warc.gz"
                    files.append(f"{folder}/{name}")
                    out, size = where.open_output_stream(f"{path}/{name}", compression=None), 0
                revisit = first is not None and first != (LAST if page is None else page)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(page, url, html or b"", ts, first, revisit)) + pack.flush()
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(files)], ["file"])

    return run


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", seconds: str | None = None) -> DataFrame:
    """(file): the archives written for pages; `seconds` names a column of capture times, else one second per page_id."""
    spark = pages.sparkSession
    folder = workspace(spark, "warc")
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    ts = F.coalesce(F.col(seconds).cast("long") if seconds else F.lit(EPOCH) + F.pmod(F.col(key), F.lit(1 << 30)), F.lit(EPOCH))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"), ts.alias("ts"))
    digest = F.sha1(F.coalesce(F.col("html"), F.lit(b"")))
    firsts = rows.select(digest.alias("d"), F.coalesce("page_id", F.lit(LAST)).alias("ord")).groupBy("d").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    firsts = save(firsts.where("last > first").select("d", "first"), "firsts")
    rows = rows.withColumn("d", digest).join(firsts, "d", "left").select("page_id", "url", "html", "ts", "first")
    return save(rows.mapInArrow(_write(folder), "file string"), "manifest")


def parse(data: bytes, offset: int) -> tuple[dict, bytes, bytes, int]:
    """(headers, HTTP head, payload, length) of the record that begins at offset; raises where a digest is wrong."""
    unpack = zlib.decompressobj(31)
    parts, at = [], offset
    while not unpack.eof:
        if at >= len(data):
            raise ValueError("the archive ends inside a record")
        chunk = data[at : at + (1 << 16)]
        parts.append(unpack.decompress(chunk))
        at += len(chunk)
    length = at - len(unpack.unused_data) - offset
    head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["WARC-Payload-Digest"]:
        raise ValueError("payload digest differs")
    return headers, http, payload, length


def records(data: bytes) -> Iterator[tuple[int, int, dict, bytes, bytes]]:
    at = 0
    while at < len(data):
        headers, http, payload, length = parse(data, at)
        yield at, length, headers, http, payload
        at += length


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            where, path = _open(uri)
            with where.open_input_file(path) as f:
                data = f.read()
            rows = []
            for offset, length, h, http, payload in records(data):
                told = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                refers = page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                ts = int(datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                rows.append((url_key(h.get("WARC-Target-URI")), ts, page_of(h["WARC-Record-ID"]), told, h["WARC-Payload-Digest"][5:], h["WARC-Type"], refers, uri, offset, length))
            schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in INDEX.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read(files: DataFrame) -> DataFrame:
    """An index row for each record of the archives; each reading task's rows are a locally sorted run."""
    n = files.count()
    spread = files.repartition(min(n, MOST_RUNS)) if n else files
    return spread.mapInArrow(_read, INDEX)


class LoserTree:
    """The least of k sorted streams, one comparison per level: an inner node keeps the loser of its match."""

    def __init__(self, streams: list[Iterator]):
        self.streams = streams
        self.k = len(streams)
        self.head = [next(s, None) for s in streams]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.loser[node]
            if other == -1:  # nobody has come here yet: wait
                self.loser[node] = winner
                return
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.k:
            best = self.loser[0]
            if self.head[best] is None:
                return
            yield self.head[best]
            self.head[best] = next(self.streams[best], None)
            self._replay(best)


def _stream(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a sorted run with low <= key < high, batch by batch; row groups outside are skipped."""
    import pyarrow.dataset as ds

    where, path = _open(uri)
    test = pc.scalar(True)
    if low is not None:
        test = test & (pc.field("urlkey") >= low[0])
    if high is not None:
        test = test & (pc.field("urlkey") <= high[0])
    if low is not None and high is not None and low[0] == high[0]:  # a part of one hot key's history
        test = test & (pc.field("ts") >= low[1]) & (pc.field("ts") <= high[1])
    table = ds.dataset(path, filesystem=where, format="parquet")
    for batch in table.scanner(filter=test, batch_size=4096, use_threads=False, batch_readahead=1, fragment_readahead=1).to_batches():
        for row in zip(*(batch.column(n).to_pylist() for n in NAMES)):
            key = (row[0], row[1], LAST if row[2] is None else row[2])
            if (low is None or key >= low) and (high is None or key < high):
                yield (key, row[7], row[8]), row


def _merge(plan, bounds: list) -> Callable:
    """Over task numbers: merge the runs plan.value[task] = (files, range) within bounds[range : range + 2]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                files, part = plan.value[task]
                rows = []
                for _, row in LoserTree([_stream(u, bounds[part], bounds[part + 1]) for u in files]):
                    rows.append((part, *row))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("part", pa.int64()), *((n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in INDEX.split(", ")))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def merge(index: DataFrame, parts: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """index in global order: `part` numbers the key ranges, and rows of a part are in order of (urlkey, ts, page_id)."""
    spark = index.sparkSession
    order = [F.col("urlkey"), F.col("ts"), F.coalesce("page_id", F.lit(LAST))]
    runs = save(index.sortWithinPartitions(*order), "runs")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a sample of fixed size tells where to cut
    sample = sorted((r["urlkey"], r["ts"], LAST if r["page_id"] is None else r["page_id"]) for r in runs.orderBy(F.xxhash64("page_id", "urlkey", "offset")).limit(SAMPLE).select("urlkey", "ts", "page_id").collect())
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    schema, bounds = "part long, " + INDEX, [None, *cuts, None]
    n = len(bounds) - 1
    # which files hold the rows of each range, in groups of at most fan_in; at first every run may hold any
    files = [sorted(runs.inputFiles())] * n

    def pass_over(groups: list[tuple[list[str], int]]) -> DataFrame:
        plan = spark.sparkContext.broadcast(groups)  # paths of at most MOST_RUNS runs
        return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(_merge(plan, bounds), schema)

    while max(map(len, files)) > fan_in:
        groups = [(own[i : i + fan_in], part) for part, own in enumerate(files) for i in range(0, len(own), fan_in)]
        longer: list[list[str]] = [[] for _ in range(n)]
        for path in save(pass_over(groups), "runs").inputFiles():
            # a task writes one file at most, and the file's name tells the task
            longer[groups[int(path.rpartition("/")[2].split("-")[1])][1]].append(path)
        files = [sorted(own) for own in longer]
    return pass_over([(own, part) for part, own in enumerate(files)])


def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return merge(read(write(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "part", "file", "offset")
