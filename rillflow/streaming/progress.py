"""What every batch of a query did, kept as a table beside its checkpoint.

Spark reports a batch's progress once and forgets all but the last hundred batches of a run. A listener
writes each report to a file of its own, named by the batch: a repeated batch replaces its report.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

from rillflow.streaming import manifests

_SCHEMA = (
    "runId string, batchId bigint, timestamp string, numInputRows bigint, "
    "eventTime map<string, string>, observedMetrics map<string, map<string, bigint>>, "
    "stateOperators array<struct<numRowsTotal: bigint, numRowsUpdated: bigint, numRowsRemoved: bigint, "
    "numRowsDroppedByWatermark: bigint>>"
)


class _Recorder(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str, names: set[str] | None) -> None:
        self.spark, self.path, self.names = spark, path, names
        self.failures: list[Exception] = []

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        report = event.progress
        if self.names is not None and report.name not in self.names:
            return
        try:
            folder = f"{self.path}/{report.runId}"
            manifests.commit(self.spark, folder, report.batchId, json.loads(report.json), keep=None)
        except Exception as error:
            self.failures.append(error)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


@contextmanager
def recorded(spark: SparkSession, path: str, names: set[str] | None = None) -> Iterator[None]:
    """Keep the reports of all queries that run inside, or of those with certain names.

    Reports arrive a little after their batch: on leaving, waits until all have. A report that could
    not be written raises there.
    """
    recorder = _Recorder(spark, path, names)
    spark.streams.addListener(recorder)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(recorder)
    if recorder.failures:
        raise recorder.failures[0]


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch of every run: ``run, batch, rows_in, dropped, removed, state_rows, watermark``
    and ``observed``.

    ``dropped`` counts groups of late rows: what arrives after its window is closed is dropped after
    it was aggregated. ``state_rows`` is what the state holds after the batch.
    """
    reports = spark.read.schema(_SCHEMA).json(f"{path}/*/*.json")

    def total(name: str) -> Column:
        sizes = F.transform("stateOperators", lambda s: F.coalesce(s[name], F.lit(0)))
        return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda x, y: x + y)

    return reports.select(
        F.col("runId").alias("run"),
        F.col("batchId").alias("batch"),
        F.col("numInputRows").alias("rows_in"),
        total("numRowsDroppedByWatermark").alias("dropped"),
        total("numRowsRemoved").alias("removed"),
        total("numRowsTotal").alias("state_rows"),
        F.to_timestamp(F.col("eventTime")["watermark"]).alias("watermark"),
        F.col("observedMetrics").alias("observed"),
    )
