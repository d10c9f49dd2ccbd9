"""A schema that is inferred once per file and kept beside a stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rillflow.streaming import manifests


def widened(one: DataType, other: DataType) -> DataType:
    """A type that holds the JSON values of both: fields of either, ``one``'s first.

    Whole numbers and doubles give doubles; other types that differ give text, which JSON of any type
    can be read as.
    """
    if isinstance(one, StructType) and isinstance(other, StructType):
        new = {field.name: field.dataType for field in other}
        fields = [
            StructField(f.name, widened(f.dataType, new.pop(f.name)) if f.name in new else f.dataType)
            for f in one
        ]
        return StructType([*fields, *(StructField(name, kind) for name, kind in new.items())])
    if isinstance(one, ArrayType) and isinstance(other, ArrayType):
        return ArrayType(widened(one.elementType, other.elementType))
    if one == other:
        return one
    if {type(one), type(other)} == {LongType, DoubleType}:
        return DoubleType()
    return StringType()


def _plain(path: Column) -> Column:
    """``file:///a`` and ``file:/a`` are one file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def files_read(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """``path``: the files that a stream's checkpoint knows, those of an unfinished batch included."""
    log = f"{checkpoint}/sources/{source}"
    if not manifests.children(spark, log):
        return spark.createDataFrame([], "path string")
    # A line with the format's version, then one JSON object per file.
    entry = F.from_json("value", "path string").getField("path")
    return spark.read.text(log).select(_plain(entry).alias("path")).where("path is not null")


def new_files(spark: SparkSession, path: str, checkpoint: str) -> list[str]:
    """The files in a directory that a stream has not read yet: one arrival, listed like it will be."""
    # Only names: a file's content is not read unless it is asked for.
    there = spark.read.format("binaryFile").load(path).select("path")
    known = files_read(spark, checkpoint)
    left = there.withColumn("plain", _plain(F.col("path"))).join(
        known, F.col("plain") == known["path"], "left_anti"
    )
    return sorted(row.path for row in left.select(there["path"]).collect())


def kept_schema(spark: SparkSession, path: str, folder: str, checkpoint: str) -> StructType:
    """The schema of a directory of JSON documents, from ``folder`` and the files not read yet.

    The first time all files are looked at; later only those that the stream of ``checkpoint`` has
    not read, which may add fields and widen types but take nothing away. Fields that are null in all
    of the first files are text, and stay so; in later ones they change nothing. A name that a path cannot
    be matched by is looked at again, which changes nothing. What arrives while a query runs is read
    with the schema it was started with. Raises if there is neither a kept schema nor a file.
    """
    kept = manifests.newest(spark, folder)
    schema = None if kept is None else StructType.fromJson(kept["schema"])
    files = new_files(spark, path, checkpoint)
    if files and schema is None:
        schema = spark.read.json(files).schema
    elif files and widened(schema, spark.read.json(files).schema) != schema:
        # A field that is null throughout is taken for text, which would widen any other type: the
        # new files are looked at once more, without such fields.
        found = spark.read.option("dropFieldIfAllNull", True).json(files).schema
        schema = widened(schema, found)
    if schema is None:
        raise FileNotFoundError(f"no JSON documents in {path} to infer a schema from")
    if kept is None or schema.jsonValue() != kept["schema"]:
        number = (manifests.numbers(spark, folder) or [-1])[-1] + 1
        manifests.commit(spark, folder, number, {"schema": schema.jsonValue()})
    return schema
