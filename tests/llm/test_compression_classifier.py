import zlib

import numpy as np

from quadloom.llm import compression_classifier as cc


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = cc.op9_quality_classifier(spark, folder).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(label[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    y, s, p = map(np.array, zip(*held))
    assert auc(y, s) > 0.95 and (y == p).mean() > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 300000, 0.5), (3, "x" * 300000, 0.5), (None, "words", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in cc.score(docs, cc.fit(docs, none)).collect()} == {0.5}
    few = spark.createDataFrame([(3, 1), (2, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert len(cc.score(docs, cc.fit(docs, few)).collect()) == 5
    model = cc.fit_texts([b"good text of some words"] * 9, [b"bad ### junk $$$"] * 9)
    rows = cc.score(docs, model).collect()
    assert len(rows) == 5 and rows[0]["score"] == rows[1]["score"] and all(0 <= r["score"] <= 1 for r in rows)
    assert cc.score(docs.limit(0), model).count() == 0
