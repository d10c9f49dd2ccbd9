"""Start a streaming query into files, Kafka, the console or an update log.

Every sink takes the query's own checkpoint folder. ``trigger`` is an interval such as
``"1 minute"``, ``AVAILABLE_NOW`` to end once all present input is done, or ``None`` to start each
batch as soon as the one before has ended.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rillflow.sources.kafka import missing_kafka
from rillflow.streaming import manifests

AVAILABLE_NOW = "available now"
# The folder of merged batches and their manifests beside the batches of an update log.
BASES = "_bases"


def _writer(
    df: DataFrame, mode: str, checkpoint: str, name: str | None, trigger: str | None
) -> DataStreamWriter:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    if trigger == AVAILABLE_NOW:
        return writer.trigger(availableNow=True)
    if trigger is not None:
        return writer.trigger(processingTime=trigger)
    return writer


def to_json_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    name: str | None = None,
    trigger: str | None = None,
    mode: str = "append",
    compression: str | None = None,
) -> StreamingQuery:
    """JSON files, each row exactly once. Spark refuses any mode but append here.

    ``compression`` (``"gzip"``) makes files several times smaller; each is then read by one task.
    """
    writer = _writer(df, mode, checkpoint, name, trigger).format("json").option("path", path)
    return writer.option("compression", compression or "none").start()


def to_record_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    name: str | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """Keyed records as parquet files, for ``replay_records`` to pick up: a topic kept as files."""
    check_record(df)
    records = df.select(*(F.col(name).cast("binary").alias(name) for name in df.columns))
    writer = _writer(records, "append", checkpoint, name, trigger)
    return writer.format("parquet").option("path", path).start()


def check_record(df: DataFrame) -> None:
    """Outgoing records have a ``value`` and at most a ``key`` besides, spelt exactly so."""
    names = set(df.columns)
    if "value" not in names or names - {"key", "value"}:
        raise ValueError(f"records need the columns value and, optionally, key; got {df.columns}")
    for name, kind in df.dtypes:
        if kind not in ("string", "binary"):
            raise ValueError(f"column {name} must be string or binary, not {kind}")


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def to_kafka(
    df: DataFrame,
    servers: str,
    topic: str,
    checkpoint: str,
    mode: str = "append",
    name: str | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """Keyed records to a topic, at least once."""
    check_record(df)
    writer = _writer(df, mode, checkpoint, name, trigger).format("kafka")
    try:
        return writer.options(**kafka_sink_options(servers, topic)).start()
    except AnalysisException as error:
        raise missing_kafka(error) from error


def to_console(
    df: DataFrame,
    checkpoint: str,
    mode: str = "append",
    name: str | None = None,
    trigger: str | None = None,
    rows: int = 20,
) -> StreamingQuery:
    """Print the first rows of each batch, in order of their columns.

    Spark's own console sink brings every row of a batch to the driver before it prints the first
    few, which a running total in complete mode outgrows. Here every partition is read to its end,
    as a stateful query must to commit its state, but hands on only its own first rows.
    """

    def show(batch: DataFrame, batch_id: int) -> None:
        print(f"Batch {batch_id}")
        order = [F.col(f"`{name}`").cast("string") if _unordered(kind) else F.col(f"`{name}`")
                 for name, kind in batch.dtypes]
        batch.orderBy(*order).limit(rows).show(rows, truncate=False)

    return _writer(df, mode, checkpoint, name, trigger).foreachBatch(show).start()


def _unordered(kind: str) -> bool:
    return "map<" in kind or "variant" in kind


def to_update_log(
    df: DataFrame,
    path: str,
    checkpoint: str,
    name: str | None = None,
    trigger: str | None = None,
    mode: str = "update",
    keys: Iterable[str] | None = None,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Keep what each batch changed, under its ``batch_id``. A repeated batch replaces itself.

    With ``keys`` and ``compact_every`` the newest row per key is merged into a base after every so
    many batches, and what the base holds is released: the log then stays as large as its keys and
    the open batches. Read such a log with ``read_update_log``.
    """
    if (keys is None) != (compact_every is None):
        raise ValueError("a log is compacted by keys and compact_every together")
    keys = None if keys is None else list(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if keys is not None and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, keys, batch_id)

    return _writer(df, mode, checkpoint, name, trigger).foreachBatch(write).start()


def compact(spark: SparkSession, path: str, keys: Iterable[str], upto: int) -> None:
    """Merge an update log up to batch ``upto`` into a base.

    The base is written first, a manifest that names it last: until then readers take the old base
    and all batches after it. What the new base replaces stays until the next one, for readers that
    have begun.
    """
    before = manifests.newest(spark, f"{path}/{BASES}")
    if before is not None and before["upto"] >= upto:
        return
    log = read_update_log(spark, path, upto)
    columns = [name for name in log.columns if name != "batch_id"]
    merged = latest(log, keys).select(*columns, F.lit(upto).cast("bigint").alias("batch_id"))
    merged.write.mode("overwrite").parquet(f"{path}/{BASES}/upto={upto}")
    manifests.commit(spark, f"{path}/{BASES}", upto, {"upto": upto})
    if before is None:
        return
    for number in _batches(spark, path):
        if number <= before["upto"]:
            manifests.remove(spark, f"{path}/batch_id={number}")
    for folder in manifests.children(spark, f"{path}/{BASES}"):
        number = folder.removeprefix("upto=")
        if number.isdigit() and int(number) < before["upto"]:
            manifests.remove(spark, f"{path}/{BASES}/{folder}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    found = (name.removeprefix("batch_id=") for name in manifests.children(spark, path))
    return sorted(int(number) for number in found if number.isdigit())


def read_update_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest base of an update log and the batches after it, with ``batch_id``.

    ``upto`` leaves out later batches. Give the result to ``latest``.
    """
    base = manifests.newest(spark, f"{path}/{BASES}")
    done = -1 if base is None else base["upto"]
    wanted = [n for n in _batches(spark, path) if n > done and (upto is None or n <= upto)]
    parts = []
    if base is not None:
        parts.append(spark.read.parquet(f"{path}/{BASES}/upto={done}"))
    if wanted:
        folders = [f"{path}/batch_id={n}" for n in wanted]
        rows = spark.read.option("basePath", path).parquet(*folders)
        parts.append(rows.withColumn("batch_id", F.col("batch_id").cast("bigint")))
    if not parts:
        raise FileNotFoundError(f"no update log in {path}")
    return reduce(DataFrame.unionByName, parts)


def latest(log: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The newest row per key of an update log read with ``spark.read.parquet``."""
    keys = list(keys)
    rest = [name for name in log.columns if name not in keys and name != "batch_id"]
    # Column by column: numbers and times stay in a hash aggregation; text, binary values and
    # structs are aggregated by sorting, which a topic kept as files has to bear.
    return log.groupBy(*keys).agg(*(F.max_by(name, "batch_id").alias(name) for name in rest))


def to_snapshots(
    df: DataFrame,
    path: str,
    checkpoint: str,
    name: str | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """Complete mode: the whole result of the last two batches, in turn in two folders.

    While a batch replaces the older of the two, the newer one stays readable.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return _writer(df, "complete", checkpoint, name, trigger).foreachBatch(write).start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result that ``to_snapshots`` has written."""
    # The number of the newest batch first, from its own small column, then that folder alone.
    both = spark.read.parquet(path).select("batch_id", "slot")
    newest = both.groupBy("slot").agg(F.max("batch_id").alias("batch_id"))
    newest = newest.orderBy(F.desc("batch_id")).first()
    if newest is None:
        return spark.read.parquet(path).drop("batch_id", "slot")
    one = spark.read.parquet(f"{path}/slot={newest.slot}")
    return one.where(F.col("batch_id") == newest.batch_id).drop("batch_id")
