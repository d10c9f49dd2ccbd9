"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.schemas import TIME_FORMAT


def tokens(line: Column) -> Column:
    """The parts of a line between single spaces, empty parts included."""
    return F.split(line, " ")


def amount_if(kind: Column, wanted: str, amount: Column) -> Column:
    """The amount for rows of one kind, 0 for all others."""
    return F.when(kind == wanted, amount).otherwise(0)


def loyalty_points(amount: Column, rate: float = 0.2) -> Column:
    return amount * rate


def reward_points(value: Column, rate: int = 2) -> Column:
    """Whole points for one line, cut toward zero; none for a value that is not a finite number."""
    return (value * rate).try_cast("bigint")


def with_event_time(
    df: DataFrame,
    column: str = "CreatedTime",
    fmt: str = TIME_FORMAT,
    metric: str = "undated",
) -> DataFrame:
    """Parse ``column`` to a timestamp; text that does not fit the format gives null.

    Rows without an event time never enter a window. How many there were is observed under the
    name ``metric`` as ``rows`` (in a stream: ``lastProgress.observedMetrics``). The observation
    also stops Spark from copying the window's null check, with the whole JSON and time parse
    inside it, below the decode: each record is parsed once instead of twice.
    """
    timed = df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(fmt)))
    return timed.observe(metric, F.count_if(F.col(column).isNull()).alias("rows"))
