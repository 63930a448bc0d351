"""Readers of the formats that features come in."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"quadloom-{label}-")
    path = f"{root.removeprefix('file://').rstrip('/')}/quadloom/{label}-{uuid.uuid4().hex[:12]}"
    os.makedirs(path)
    return path


#: Rows of a part at most: what a reader must hold of a format that is read whole.
PART_ROWS = 200_000


def write_parts(rows: DataFrame, folder: str, suffix: str, write: Callable[[str, Iterator[tuple]], None], part_rows: int = PART_ROWS) -> int:
    """Files of `folder`, written by the tasks, one or more for each partition of rows; the number of files.

    write takes the rows of a file as they come: no task holds more than a few hundred of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (tuple(r.values()) for b in batches for lo in range(0, b.num_rows, 512) for r in b.slice(lo, 512).to_pylist())
        for head in rest:
            name = f"{folder}/{uuid.uuid4().hex}"
            write(name, chain([head], islice(rest, part_rows - 1)))
            os.replace(name, name + suffix)  # a lost task leaves no half-written part
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return rows.mapInArrow(run, "file string").count()
