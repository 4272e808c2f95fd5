"""Streaming intake: items arrive as a stream, repeated deliveries are dropped, batches reach a sink once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_deliveries(stream: DataFrame, keys: list[str], event_time: str, lateness: str = "7 days") -> DataFrame:
    """Rows without repeated deliveries of a key within ``lateness``; the state of older keys is dropped."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def counts_per_window(stream: DataFrame, event_time: str, width: str, by: str, lateness: str = "7 days") -> DataFrame:
    """Rows per window of event time and ``by``; rows later than ``lateness`` are left out."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, width), by).agg(F.count(F.lit(1)).alias("rows"))


def drain_to(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand everything that is there to ``handle`` in micro-batches and stop.

    ``handle`` gets a batch and its number; a batch may be handed over again after a
    failure under the same number, so a handler writes by number or by key. With the mode
    ``complete`` each batch is the whole result so far.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
