"""Event-time windows.

Both aggregate per task before the one shuffle, so what is shuffled grows with the number of
windows (times keys), not with the rows, and a window or key that holds a large part of all rows
arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.expressions import amount_if


def _bounded(rows: DataFrame, delay: str | None) -> DataFrame:
    """Set a watermark on streams; tables are complete and need none."""
    if delay is None or not rows.isStreaming:
        return rows
    return rows.withWatermark("CreatedTime", delay)


def trade_totals(
    trades: DataFrame, width: str = "15 minutes", delay: str | None = None
) -> DataFrame:
    """``start, end, TotalBuy, TotalSell`` of all trades in each tumbling window.

    Without ``delay`` nothing is ever late, and a stream keeps every window in its state.
    """
    kind, amount = F.col("Type"), F.col("Amount")
    return (
        _bounded(trades, delay)
        .groupBy(F.window("CreatedTime", width))
        .agg(
            F.sum(amount_if(kind, "BUY", amount)).alias("TotalBuy"),
            F.sum(amount_if(kind, "SELL", amount)).alias("TotalSell"),
        )
        .select("window.start", "window.end", "TotalBuy", "TotalSell")
    )


def sensor_max(
    readings: DataFrame,
    width: str = "15 minutes",
    slide: str = "5 minutes",
    delay: str | None = "30 minutes",
) -> DataFrame:
    """``SensorID, start, end, MaxReading`` in sliding windows.

    On a stream, windows that end ``delay`` or more before the latest event time are closed: their
    state is dropped and rows that still arrive for them are ignored. ``delay=None`` keeps all.
    """
    return (
        _bounded(readings, delay)
        .groupBy("SensorID", F.window("CreatedTime", width, slide))
        .agg(F.max("Reading").alias("MaxReading"))
        .select("SensorID", "window.start", "window.end", "MaxReading")
    )
