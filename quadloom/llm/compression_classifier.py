"""Quality classifier by compression: zstandard dictionaries of good and bad labelled text.

A text is compressed in chunks with a dictionary trained on good text and with one trained on
bad text. The difference of the compressed sizes per byte says which it resembles; a logistic
curve fitted on other labelled rows turns it into a probability.

Labels are learned from a bounded sample: at most SAMPLE_ROWS rows per class, the first in an
order seeded by hash, of texts up to SAMPLE_BYTES; two thirds of these train the dictionaries,
one third the curve. Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never
learned from. Scores cover every whole text; a model is two dictionaries of DICT_BYTES at most.

Defined results: null and empty texts have difference 0 and the score of the curve there;
repeated rows score alike; without labels of both classes every score is the share of good
labels (0.5 without any); null labels are not used; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 32 << 10
DICT_BYTES = 112 << 10
CHUNK = 2048
LEVEL = 3
CUT = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    parts = [c for t in texts for c in chunks(t)]
    np.random.default_rng(0).shuffle(parts)
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(parts)[-DICT_BYTES:]


def compressor(content: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) per byte."""
    parts = chunks(text)
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / max(1, len(text))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge."""
    scale = float(np.std(x)) or 1.0
    a, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return float(w[0] / scale), float(w[1])


def fit_texts(good: list[bytes], bad: list[bytes]) -> Model:
    if not good or not bad:
        p = min(max(len(good) / (len(good) + len(bad)), 0.01), 0.99) if good or bad else 0.5
        return Model(b"", b"", 0.0, math.log(p / (1 - p)))
    few = min(len(good), len(bad)) < 6
    learn = [[t for i, t in enumerate(c) if few or i % 3] for c in (good, bad)]
    rest = [[t for i, t in enumerate(c) if few or not i % 3] for c in (good, bad)]
    model = Model(dictionary(learn[0]), dictionary(learn[1]), 0.0, 0.0)
    g, b = compressor(model.good), compressor(model.bad)
    x = np.array([difference(t, g, b) for c in rest for t in c])
    y = np.array([1.0] * len(rest[0]) + [0.0] * len(rest[1]))
    model.slope, model.intercept = logistic(x, y)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the sampled rows of labels that are not held out."""
    texts: dict[int, list[bytes]] = {}
    for value in (1, 0):
        few = labels.where(F.col(label) == value).where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(key).distinct()
        few = few.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
        # SAMPLE_ROWS ids at most: a side of bounded size
        rows = docs.select(key, text).join(F.broadcast(few), key, "left_semi").where(F.octet_length(text).between(1, SAMPLE_BYTES)).dropDuplicates([key])
        texts[value] = [r[text].encode() for r in sorted(rows.collect(), key=lambda r: r[key])]
    return fit_texts(texts[1], texts[0])


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(model.good), compressor(model.bad)
        for batch in batches:
            x = np.array([difference(t.as_py() or b"", good, bad) for t in batch.column(2).cast(pa.binary())], dtype=np.float64)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return source.mapInArrow(_scores(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
