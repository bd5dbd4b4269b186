"""Feed a stream of prediction batches into the dated history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from paneloom.sources.history import append_epoch


def append_stream(
    batches: DataFrame, path: str, checkpoint: str, date_col: str = "DATE", *, source: str | None = None
) -> DataStreamWriter:
    """Writer that adds each micro-batch with :func:`append_epoch`: replayed ones add nothing, split dates stay whole.

    ``source`` names the stream in the ledger (default: its checkpoint folder, which outlives restarts).
    """
    def add(batch: DataFrame, epoch: int) -> None:
        append_epoch(batch, path, source or checkpoint, epoch, date_col)

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
