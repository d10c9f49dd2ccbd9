"""Session building and shared scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Session settings the jobs rely on at scale. UTC: event times on the wire carry no zone, and the
# parse takes the session's. AQE: splits skewed joins and merges small shuffle partitions; it splits
# early, since what follows a join here is costly per byte (encoding and parsing).
# RocksDB: keeps keyed state off the JVM heap, which matters for the aggregations that have no
# event time to expire by (word counts, rewards per card); its changelog keeps each commit as
# small as the batch's changes.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with ``conf``, and ``SCALE_CONF`` where neither that nor the cluster sets a key.

    The master is left to the caller. ``spark.sql.shuffle.partitions`` is fixed in a stateful
    query's checkpoint by its first batch, so choose it before the first run.
    """
    conf = conf or {}
    builder = SparkSession.builder.appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    cluster = spark.sparkContext.getConf()
    for key, value in SCALE_CONF.items():
        if key not in conf and not cluster.contains(key):
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """What runs inside runs with ``conf``; the session has its own settings back afterwards."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for tables and stream checkpoints that every executor must reach.

    Lies in the session's own folder, see ``scratch_root``.
    """
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """The folder of all this session's scratch tables, which may go when it ends.

    Below the folder named by ``spark.checkpoint.dir``, else below the warehouse, which the machines
    of a cluster share as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/rillflow-{spark.conf.get('spark.app.id')}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this session's scratch folder: no query result that reads from it may be in use."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(root, True)
