"""What the operators share: staged tables, Arrow batches of documents, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.session import scratch_dir

# Rows of one Arrow batch: bounds a Python worker's memory where documents are long.
BATCH_ROWS = 1000
# For tables whose rows hold several MB each. Parquet keeps a group of rows in memory, to write it and
# to read it, and left alone looks at its size only after 100 rows.
LARGE_ROWS = {
    "parquet.block.size": 4 << 20,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
}


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, options: Mapping[str, object] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: computed once, lineage cut.

    ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches, and workers that find this package where the driver does.

    On a cluster the package is installed or shipped like any other; the path only helps sessions
    on one machine that were started elsewhere.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def texts_of(docs: DataFrame, *also: str | Column) -> DataFrame:
    """Only ``doc_id``, ``text`` and what is asked for: other columns cannot clash."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text", *also)


# Columns of documents that operators read by name.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions from documents to documents: no other column can clash with names used inside.

    Columns beside those of OWN are renamed on the way in and get their names back on the way out.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        names = [name if name in OWN else f"extra_{i}" for i, name in enumerate(docs.columns)]
        return stage(docs.toDF(*names), *args, **options).toDF(*docs.columns)

    return run


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str
) -> DataFrame:
    """``function`` gives the columns of ``schema`` for each Arrow batch of ``df``."""
    prepare(df.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names=names)

    return df.mapInArrow(typed(run, schema), schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a flat DDL text."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
    }
    pairs = (field.split() for field in schema.split(", "))
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def typed(run: Callable, schema: str) -> Callable:
    """Batches with exactly the declared types, also where a batch is empty or all null."""
    wanted = arrow_schema(schema)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            columns = [batch.column(i).cast(f.type) for i, f in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return cast


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over the links ``a, b``.

    Alternates two star contractions until nothing changes: every node hands its larger neighbours
    to the smallest node it knows, then every node hands its smaller ones on. The number of rounds
    grows with the logarithm of the longest chain. A hub's rows are pre-aggregated by the minimum
    and joined with one row per node, which the adaptive planner splits. Nodes without links do not
    appear; links with a null end are ignored.
    """
    spark = links.sparkSession
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    whole = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = staged(whole.select(low, high).where("a < b").distinct(), "links")
    digest = _digest(pairs)
    while digest[0]:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.distinct()
        roots = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(roots, "b").where("a <> m")
        moved = moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = roots.select(F.col("m").alias("a"), "b").union(moved).distinct()
        pairs = staged(small, "links")
        before, digest = digest, _digest(pairs)
        if digest == before:
            break
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return nodes.union(roots) if digest[0] else spark.createDataFrame([], "node long, component long")


def _digest(pairs: DataFrame) -> tuple[int, int]:
    """Number of links and an order-free sum over them: equal only if no link has changed."""
    hashed = F.xxhash64("a", "b").cast("decimal(20,0)")
    row = pairs.agg(F.count("*").alias("n"), F.sum(hashed).alias("h")).first()
    return row.n, int(row.h or 0)
