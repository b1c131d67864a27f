"""Projection, restriction, aggregation and joins with static relations are DataFrame functions, so they apply to
streaming DataFrames as they are; this starts such a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_to(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory", path: str | None = None) -> StreamingQuery:
    """Runs a streaming relation on all that is there, then stops; mode "complete" for aggregates without a watermark."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True)
    return writer.format(sink).start(path) if path else writer.format(sink).start()
