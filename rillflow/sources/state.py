"""The state of a stateful query as a table, read from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rillflow.session import SCALE_CONF


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per state store of a checkpoint: operator, its name, store and partitions."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_rows(
    spark: SparkSession,
    checkpoint: str,
    operator: int = 0,
    store: str = "default",
    batch_id: int | None = None,
) -> DataFrame:
    """``key, value, partition_id``: what a store holds after its last batch, or after ``batch_id``.

    Read in as many tasks as the query has state partitions; keys and values are structs.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    reader = reader.option("storeName", store)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


@contextmanager
def scaled_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state as ``SCALE_CONF`` says: off the heap, by changelog.

    The choice goes into a query's checkpoint with its first batch.
    """
    chosen = {k: v for k, v in SCALE_CONF.items() if k.startswith("spark.sql.streaming.stateStore")}
    before = {key: spark.conf.get(key, None) for key in chosen}
    for key, value in chosen.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
