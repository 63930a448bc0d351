import re

import numpy as np
import pytest

from quadloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    """Reshare by weight until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def check(rows, docs):
    sizes, taken = {}, {}
    for d, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = expected_targets(sizes)
    source_of = {d: s for d, _, s in docs}
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= mixing.BLOCK
    return taken


def test_small_tables(spark, documents):
    first = mixing.op5_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(first) == len(documents)
    check(first, documents)
    again = mixing.op5_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_edges(spark, table):
    docs = [(1, None, "b"), (2, "", None), (3, "one two\x0bthree x", None), (4, "w " * 900, "a"), (5, "w " * 50, "c"), (6, "v " * 70, "é")]
    folder = table("documents", docs, "doc_id long, text string, source string")
    rows = mixing.op5_mixing(spark, folder).collect()
    check(rows, docs)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert mixing.mix(df.limit(0)).count() == 0
    extra = df.selectExpr("*", "1 as size", "2 as shard", "'z' as target")
    assert set(mixing.mix(extra).columns) == {"doc_id", "text", "source", "size", "shard", "source_size", "target", "taken"}
    odd = df.selectExpr("*", "7 as size", "8 as _size", "9 as _shard", "'z' as Target", "1 as `a.b`", "2 as k")
    mixed = mixing.mixed_texts(odd)
    assert mixed.columns == odd.columns
    assert {tuple(r)[3:] for r in mixed.collect()} == {(7, 8, 9, "z", 1, 2)}
    assert {r["doc_id"]: r["_size"] for r in mixing.mix(odd).collect()} == {d: 8 for d, _, _ in docs}
    texts = mixing.mixed_texts(df).collect()
    words = {}
    for r in texts:
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert words == {s: n for s, n in check(mixing.mix(df).collect(), docs).items() if n}


def test_rows_that_repeat(spark):
    df = spark.createDataFrame([(1, "a b c d", "s")] * 9 + [(None, "x y z", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 10 and all(r["taken"] <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_takes_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    w, n = rng.integers(0, 50, 7).astype(float), int(rng.integers(0, 60))
    got = np.zeros(7, dtype=int)
    for _ in range(n if w.sum() else 0):
        got[np.argmax(w / (2 * got + 1))] += 1
    assert mixing.sainte_lague(w, n).tolist() == got.tolist()
