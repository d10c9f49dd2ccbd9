"""Several results from one stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillflow.schemas import ddl
from rillflow.streaming import manifests
from rillflow.streaming.sinks import _writer, to_json_files

# The folder of manifests beside the branches.
BATCHES = "_batches"

Branches = Mapping[str, Callable[[DataFrame], DataFrame]]


def fan_out(
    stream: DataFrame,
    branches: Branches,
    path: str,
    checkpoint: str,
    trigger: str | None = None,
    compression: str | None = None,
) -> dict[str, StreamingQuery]:
    """One independent query per branch, into JSON files under ``path/<branch>``.

    Each query has its own checkpoint and reads the source by itself, so the branches may be at
    different positions and one can fail without the others.
    """
    started: dict[str, StreamingQuery] = {}
    try:
        for name, transform in branches.items():
            started[name] = to_json_files(
                transform(stream),
                f"{path}/{name}",
                f"{checkpoint}/{name}",
                name,
                trigger,
                compression=compression,
            )
    except Exception:
        for query in started.values():
            query.stop()
        raise
    return started


def fan_out_single_read(
    stream: DataFrame,
    branches: Branches,
    path: str,
    checkpoint: str,
    name: str | None = None,
    trigger: str | None = None,
    compression: str | None = None,
) -> StreamingQuery:
    """One query that reads and decodes each batch once and writes it to every branch in turn.

    Files go to ``path/<branch>/batch_id=<n>``. When all branches are written, a manifest says so, and
    ``read_branch`` gives no batch that is not in it: a batch is in all branches or in none. A batch
    that is repeated before its manifest replaces its own files, one repeated after it is left alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = manifests.newest(spark, f"{path}/{BATCHES}")
        if done is not None and done["upto"] >= batch_id:
            return
        batch.persist()
        try:
            for branch, transform in branches.items():
                writer = transform(batch).write.mode("overwrite")
                writer = writer.option("compression", compression or "none")
                writer.json(f"{path}/{branch}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        content = {"upto": batch_id, "branches": list(branches)}
        manifests.commit(spark, f"{path}/{BATCHES}", batch_id, content)

    return _writer(stream, "append", checkpoint, name, trigger).foreachBatch(write).start()


def read_branch(
    spark: SparkSession, path: str, branch: str, fields: Mapping[str, str]
) -> DataFrame:
    """What all committed batches of ``fan_out_single_read`` hold for one branch.

    Batches are written one after the other, so the newest manifest stands for all before it; the
    folders of later ones are not read.
    """
    done = manifests.newest(spark, f"{path}/{BATCHES}")
    if done is None:
        return spark.createDataFrame([], ddl(fields))
    if branch not in done["branches"]:
        raise ValueError(f"no branch {branch} in {path}: there are {done['branches']}")
    rows = spark.read.schema(f"{ddl(fields)}, batch_id bigint").json(f"{path}/{branch}")
    return rows.where(F.col("batch_id") <= done["upto"]).select(*fields)
