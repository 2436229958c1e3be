"""Windowed distinct counts on streams, and their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketches import fm_window
from ..sources.reports import append_batch


def distinct_stream(stream: DataFrame, ts: str, value: str, window: str = "30 seconds", slide: str = "10 seconds", late: str = "5 seconds", append: bool = True) -> DataFrame:
    """The sketch and the exact count of each closed window; rows later than ``late`` are dropped.

    In append mode a value is kept once for each open window, in rows of the state that end with the window. Without
    ``append`` (complete and update mode take no second stateful step), a window's values are one row of the state.
    """
    return fm_window(stream, ts, value, window, slide, watermark=late, values_apart=append)


def start(counts: DataFrame, checkpoint: str, csv: str | None = None, table: str | None = None, every: str | None = None) -> StreamingQuery:
    """Runs the query into an appending CSV report or a table in memory.

    ``every`` is the trigger interval; without it, all that is there is processed and the query ends. The state is
    kept under ``checkpoint``, from which a query goes on after a failure.
    """
    writer = counts.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if table:
        return writer.format("memory").queryName(table).start()

    def report(batch: DataFrame, number: int) -> None:
        rows = [tuple(r) for r in batch.orderBy("window_start").collect()]  # one row a window
        append_batch(csv, number, ["Time", "Ground Truth", "Estimation"], lambda state: (rows, state))

    return writer.foreachBatch(report).start()
