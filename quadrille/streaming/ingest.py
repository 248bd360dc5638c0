"""Inserts from a stream: each micro-batch becomes files of a layout."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.layout import Layout


def ingest(stream: DataFrame, layout: Layout, checkpoint: str, new_ids_only: bool = False) -> StreamingQuery:
    """Inserts (id, x, y) rows as they arrive. A batch has a name, of its checkpoint folder and number, so that one that is run again after a failure is added once and whole.

    new_ids_only: leaves out ids that the layout holds, for which each batch reads the ids of the whole layout.
    """
    own = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        new = batch.join(layout.points().select("id"), "id", "left_anti") if new_ids_only else batch
        layout.insert(new, f"{own}-{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
