"""Keyed records from Kafka topics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rillflow.functions.codecs import ConnectorMissing


def kafka_source_options(
    servers: str, topic: str, starting: str = "earliest", **options: str
) -> dict[str, str]:
    """Reader options. ``starting`` counts for a new query only; a checkpoint goes before it.

    For large topics pass ``maxOffsetsPerTrigger`` to bound a batch and ``minPartitions`` to have a
    crowded topic partition read by several tasks.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **options,
    }


def missing_kafka(error: AnalysisException) -> ConnectorMissing | AnalysisException:
    """A clear error where the connector is absent, any other error unchanged."""
    if "data source: kafka" in str(error):
        return ConnectorMissing(
            "Kafka needs --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<Spark version>"
        )
    return error


def kafka_records(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options: str
) -> DataFrame:
    """A topic as a stream of ``key, value, topic, partition, offset, timestamp, timestampType``."""
    reader = spark.readStream.format("kafka").options(
        **kafka_source_options(servers, topic, starting, **options)
    )
    try:
        return reader.load()
    except AnalysisException as error:
        raise missing_kafka(error) from error
