"""Decode and encode the ``value`` of keyed records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.avro.functions import from_avro, to_avro

from rillflow.schemas import ddl


class ConnectorMissing(RuntimeError):
    """A Spark module that is shipped as a separate package is not on the class path."""


def _avro_missing(error: AnalysisException) -> ConnectorMissing | AnalysisException:
    if "AVRO" in (error.getCondition() or ""):
        return ConnectorMissing(
            "Avro functions need --packages org.apache.spark:spark-avro_2.13:<Spark version>"
        )
    return error


def _decoded(
    records: DataFrame,
    value: Column,
    key_as: str | None,
    expand: bool,
    drop_malformed: bool,
    metric: str | None,
    keep: Iterable[str] = (),
    quarantine: str | None = None,
) -> DataFrame:
    key = [] if key_as is None else [F.col("key").cast("string").alias(key_as)]
    beside = [*([] if key_as is None else [key_as]), *keep]
    raw = [] if quarantine is None else [F.col("value").cast("binary").alias(quarantine)]
    rows = records.select(*key, *keep, *raw, value.alias("value"))
    fields = rows.schema["value"].dataType.names
    blank = reduce(Column.__and__, (F.col("value").getField(name).isNull() for name in fields))
    if metric is not None:
        rows = rows.observe(metric, F.count("*").alias("rows"), F.count_if(blank).alias("blank"))
    if drop_malformed:
        rows = rows.where(~blank)
    if quarantine is not None:
        # The bytes of a record that was decoded are not carried on.
        bytes_of = F.when(blank, F.struct(F.col(quarantine).alias("value")))
        rows = rows.withColumn(quarantine, bytes_of)
        beside.append(quarantine)
    if not expand:
        return rows
    return rows.select(*beside, "value.*")


def decode_json(
    records: DataFrame,
    fields: Mapping[str, str],
    only: Iterable[str] | None = None,
    key_as: str | None = None,
    expand: bool = True,
    drop_malformed: bool = False,
    metric: str | None = None,
    keep: Iterable[str] = (),
    quarantine: str | None = None,
) -> DataFrame:
    """Parse the JSON in ``value``: one column per field, or one struct if not ``expand``.

    Text that is not JSON gives nulls, and a field of the wrong type is null by itself. ``only``
    narrows the parse to the fields the caller uses. ``key_as`` keeps the key, as text, ``keep``
    names further columns of the records to keep.
    ``drop_malformed`` drops the rows in which every wanted field is null.

    ``metric`` names an observation (in a stream: ``lastProgress.observedMetrics``) of how many
    ``rows`` were decoded and how many of them are ``blank``: every wanted field null. It also keeps
    Spark from copying later filters, each with a whole parse inside, below the decode, so that
    every record is parsed once. Names must differ within one query.

    ``quarantine`` names a column that holds the undecoded ``value``, in a struct, of every blank
    record, and null for all others; ``decoded_rows`` and ``quarantined_rows`` part the two.
    """
    if quarantine is not None and (metric is None or drop_malformed):
        raise ValueError("a quarantine needs a metric and all rows")
    value = F.from_json(F.col("value").cast("string"), ddl(fields, only))
    return _decoded(records, value, key_as, expand, drop_malformed, metric, keep, quarantine)


def decoded_rows(rows: DataFrame, quarantine: str) -> DataFrame:
    """What ``decode_json(quarantine=...)`` could decode, without the column of the quarantine."""
    return rows.where(F.col(quarantine).isNull()).drop(quarantine)


def quarantined_rows(rows: DataFrame, quarantine: str, keep: Iterable[str]) -> DataFrame:
    """What it could not: the columns it was told to ``keep`` and the ``raw`` bytes."""
    raw = F.col(quarantine).getField("value").alias("raw")
    return rows.where(F.col(quarantine).isNotNull()).select(*keep, raw)


def decode_avro(
    records: DataFrame,
    schema: str,
    key_as: str | None = None,
    expand: bool = True,
    drop_malformed: bool = False,
    metric: str | None = None,
) -> DataFrame:
    """Like ``decode_json`` for Avro bytes written with the record document ``schema``."""
    try:
        # Else bytes that do not fit the schema end the query before they can be dropped.
        value = from_avro(F.col("value"), schema, {"mode": "PERMISSIVE"})
        return _decoded(records, value, key_as, expand, drop_malformed, metric)
    except AnalysisException as error:
        raise _avro_missing(error) from error


def _row(fields: str | Iterable[str]) -> Column:
    return F.struct("*") if fields == "*" else F.struct(*fields)


def encode_json(df: DataFrame, key: str, fields: str | Iterable[str] = "*") -> DataFrame:
    """Records with ``key`` as text and the chosen fields as a JSON ``value``.

    Null fields are left out of the JSON; a row of nulls gives ``{}``.
    """
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(_row(fields)).alias("value"))


def encode_avro(
    df: DataFrame, key: str, fields: str | Iterable[str] = "*", schema: str = ""
) -> DataFrame:
    """Like ``encode_json`` with an Avro ``value``.

    Pass the record document the reader uses as ``schema``: the one that follows from the row has
    no null branch for columns that cannot be null.
    """
    try:
        value = to_avro(_row(fields), schema).alias("value")
        return df.select(F.col(key).cast("string").alias("key"), value)
    except AnalysisException as error:
        raise _avro_missing(error) from error
