"""Waiting for queries."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def finish(
    queries: StreamingQuery | Iterable[StreamingQuery], timeout: float | None = None
) -> None:
    """Wait until all queries have ended by themselves; stop them all if one fails or time is up.

    Without ``timeout`` there is no limit.
    """
    waiting = [queries] if isinstance(queries, StreamingQuery) else list(queries)
    end = None if timeout is None else time.monotonic() + timeout
    try:
        for query in waiting:
            if end is None:
                query.awaitTermination()
            elif not query.awaitTermination(max(0.001, end - time.monotonic())):
                raise TimeoutError(f"query {query.name or query.id} still runs after {timeout} s")
    finally:
        for query in waiting:
            query.stop()


@contextmanager
def running(query: StreamingQuery) -> Iterator[StreamingQuery]:
    """A query without an end of its own, stopped on leaving; its failure raises there."""
    try:
        yield query
    finally:
        query.stop()
    failed = query.exception()
    if failed is not None:
        raise failed


def catch_up(query: StreamingQuery) -> None:
    """Wait until a running query has done all that its source holds at this moment.

    Raises if the query fails meanwhile. With an interval trigger this takes up to one interval.
    """
    query.processAllAvailable()


def wait_for_any(spark: SparkSession, timeout: float | None = None) -> bool:
    """Wait until any query of the session ends; raises if it failed. False when time is up."""
    if timeout is None:
        spark.streams.awaitAnyTermination()
        return True
    return bool(spark.streams.awaitAnyTermination(timeout))
