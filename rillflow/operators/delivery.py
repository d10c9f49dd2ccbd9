"""Records that may be delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivered_once(
    items: DataFrame, delay: str, key: str = "LineId", time: str = "CreatedTime"
) -> DataFrame:
    """One row per ``key``: the others are further deliveries of it.

    A stream remembers a key until the latest event time, in milliseconds in ``time``, is ``delay``
    past its own, and ignores what is older than that when it arrives, or has no time. Rows without
    a key are all kept. One key is one row of state, spread by the key's hash.
    """
    known = items.withColumn(key, F.coalesce(key, F.expr("uuid()")))
    if not items.isStreaming:
        return known.dropDuplicates([key])
    timed = known.withColumn("EventTime", F.timestamp_millis(time)).where("EventTime is not null")
    return timed.withWatermark("EventTime", delay).dropDuplicatesWithinWatermark([key]).drop("EventTime")
