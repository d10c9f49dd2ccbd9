"""Running totals per key.

Spark aggregates these per task before the shuffle, so a key that holds a large part of all rows
reaches its reducer as one row per task. On a stream the state holds one row per key for ever:
there is no event time to expire it by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.expressions import reward_points, tokens


def word_count(lines: DataFrame) -> DataFrame:
    """``value, count``: how often each token occurs in the ``value`` column."""
    return lines.select(F.explode(tokens(F.col("value"))).alias("value")).groupBy("value").count()


def prime_rewards(
    items: DataFrame, segment: str = "PRIME", rate: int = 2, total_type: str = "double"
) -> DataFrame:
    """``CustomerCardNo, TotalPurchase, AggregatedRewards`` of one customer segment.

    Points are cut to whole numbers per line, before they are summed. A sum of doubles depends on
    the order in which tasks finish; a decimal ``total_type`` makes ``TotalPurchase`` exact.
    """
    return (
        items.where(F.col("CustomerType") == segment)
        .groupBy("CustomerCardNo")
        .agg(
            F.sum(F.col("TotalValue").cast(total_type)).alias("TotalPurchase"),
            F.sum(reward_points(F.col("TotalValue"), rate)).alias("AggregatedRewards"),
        )
    )
