"""New items from a stream, vetted against a fixed item set batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.constructs import item_fit


def vet_stream(candidates: DataFrame, items: DataFrame, labels: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the verdict of each candidate (ord, v) of a stream to Parquet; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, epoch: int) -> None:
        item_fit(batch, items, labels).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
