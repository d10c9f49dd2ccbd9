"""Small numbered files that say what readers may take: the last step of every commit.

A manifest is written under another name and renamed, so it is there as a whole or not at all. Only
the newest counts. The files go through Spark's file systems and are reached like any table.
"""

from __future__ import annotations

import json

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    target, files = _path(spark, folder)
    if not files.exists(target):
        return []
    return [status.getPath().getName() for status in files.listStatus(target)]


def remove(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def commit(
    spark: SparkSession, folder: str, number: int, content: dict, keep: int | None = 2
) -> None:
    """Write manifest ``number``, replacing one of that number, and drop all but the last ``keep``."""
    target, files = _path(spark, f"{folder}/{number}.json")
    draft, _ = _path(spark, f"{folder}/.{number}.draft")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    # The content of a repeated number is the same: a moment without it only shows the one before.
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"manifest {folder}/{number}.json could not be put in place")
    for old in [] if keep is None else numbers(spark, folder)[:-keep]:
        remove(spark, f"{folder}/{old}.json")


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests, rising."""
    stems = [name.removesuffix(".json") for name in children(spark, folder) if name.endswith(".json")]
    return sorted(int(stem) for stem in stems if stem.isdigit())


def read(spark: SparkSession, folder: str, number: int) -> dict:
    target, files = _path(spark, f"{folder}/{number}.json")
    size = files.getFileStatus(target).getLen()
    source = files.open(target)
    try:
        return json.loads(bytes(source.readNBytes(size)))
    finally:
        source.close()


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The content of the newest manifest."""
    found = numbers(spark, folder)
    return read(spark, folder, found[-1]) if found else None
