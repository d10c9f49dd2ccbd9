"""Directories as streams. New files are picked up in order of their modification time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from rillflow.schemas import RECORD, ddl


def _file_stream(
    spark: SparkSession, max_files: int | None, options: Mapping[str, str]
) -> DataStreamReader:
    reader = spark.readStream.options(**options)
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def text_lines(
    spark: SparkSession, path: str, max_files: int | None = None, **options: str
) -> DataFrame:
    """One row per line of the text files in a directory, column ``value``."""
    return _file_stream(spark, max_files, options).text(path)


def json_dir(
    spark: SparkSession,
    path: str,
    fields: Mapping[str, str] | StructType | None = None,
    archive_dir: str | None = None,
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """The JSON documents in a directory, one per line.

    Without ``fields`` the schema is inferred from the files already there, which reads all of them
    once more before the stream starts (``samplingRatio`` reads fewer) and fails on an empty
    directory; ``inference.kept_schema`` reads only the new ones. ``archive_dir`` receives each file once a later batch has been finished; it must lie
    outside ``path``.
    """
    if archive_dir is not None:
        inside = archive_dir.rstrip("/") + "/"
        if inside.startswith(path.rstrip("/") + "/"):
            raise ValueError("archive_dir must lie outside the source directory")
        options = {**options, "cleanSource": "archive", "sourceArchiveDir": archive_dir}
    reader = _file_stream(spark, max_files, options)
    if fields is not None:
        schema = fields if isinstance(fields, StructType) else ddl(fields)
        return reader.schema(schema).json(path)
    setting = "spark.sql.streaming.schemaInference"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        return reader.json(path)
    finally:
        spark.conf.set(setting, before)


def replay_records(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    also: Mapping[str, str] | None = None,
    **options: str,
) -> DataFrame:
    """Keyed records kept as parquet files, as a stream: what a topic would deliver.

    ``also`` names columns that the files hold beside the records.
    """
    fields = {**RECORD, **(also or {})}
    return _file_stream(spark, max_files, options).schema(ddl(fields)).parquet(path)


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The same records as a table."""
    return spark.read.schema(ddl(RECORD)).parquet(path)
