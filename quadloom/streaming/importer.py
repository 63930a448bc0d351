"""Import from a stream: each micro-batch of features is classified, put into cells and appended to the store.

A batch's files lie in a folder of its own, named by the batch, so a batch that runs again
after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quadloom.plans.profile import DEFAULT, Profile
from quadloom.plans.render import import_features, write_store


def start(features: DataFrame, store: str, checkpoint: str, profile: Profile = DEFAULT, once: bool = False) -> StreamingQuery:
    """Begin to import a stream of (id, geom_type, parts, tags, area); with once, stop when all there is has been read."""

    def append(batch: DataFrame, number: int) -> None:
        write_store(import_features(batch, profile), f"{store}/batch={number}")

    writer = features.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
