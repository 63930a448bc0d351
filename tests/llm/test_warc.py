import base64
import gzip
import hashlib
import random

from quadloom.llm import warc

SCHEMA = "page_id long, url string, html string, d string"


def expected(rows):
    first = {}
    for p, _, h in rows:
        first.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        low = min((x for x in first[h or ""] if x is not None), default=None)
        revisit = low is not None and p != low
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_small_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    df = warc.op3_warc_index_merge(spark, "/root/testdata/sf0.001")
    assert result(df) == expected([(r["page_id"], r["url"], r["html"]) for r in pages])


def test_edges(spark, table):
    rows = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "é" * 70000), (4, "http://b.example/\r\nbad", "WARC/1.1\r\n\r\n"), (5, "not a url [", "é" * 70000), (-6, "HTTP://WWW.A.example/X?q=1", "p"), (7, "http://a.example/x", "p"), (7, "http://a.example/x", "p"), (None, "http://c.example", "p"), (None, "http://c.example", "only")]
    df = warc.op3_warc_index_merge(spark, table("pages", [(*r, "x") for r in rows], SCHEMA))
    assert result(df) == expected(rows)
    assert warc.merge(warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example/{i}", f"page {i % 7}") for i in range(40)], "page_id long, url string, html string")
    for r in warc.write(pages).collect():
        path = r["file"].removeprefix("file://")
        data = open(path, "rb").read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        for _, _, h, _, payload in warc.records(data):
            page = warc.page_of(h["WARC-Record-ID"])
            assert (payload == f"page {page % 7}".encode()) == (page < 7)


def test_index_is_in_global_order_however_many_runs(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{'hot' if rng.random() < 0.4 else rng.randint(0, 30)}.example/", f"{i}", rng.randint(0, 50)) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, t long").repartition(7)
    index = warc.read(warc.write(pages, seconds="t"))
    for fan_in in (64, 3):
        got = [tuple(r) for r in warc.merge(index, parts=5, fan_in=fan_in).collect()]
        assert [g[1:4] for g in got] == sorted((warc.url_key(u), t, i) for i, u, _, t in rows)
        assert [g[0] for g in got] == sorted(g[0] for g in got) and len({g[0] for g in got}) == 5


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
