"""Kafka and socket wiring; the connector itself is a separate Spark package."""

from __future__ import annotations

import pytest

from helpers import records
from rillflow.functions.codecs import ConnectorMissing
from rillflow.sources.kafka import kafka_records, kafka_source_options
from rillflow.sources.sockets import socket_lines, socket_options
from rillflow.streaming.sinks import check_record, kafka_sink_options, to_kafka


def test_source_options():
    assert kafka_source_options("h:9092", "invoices") == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "invoices",
        "startingOffsets": "earliest",
    }
    more = kafka_source_options("h:9092", "t", "latest", maxOffsetsPerTrigger="1000")
    assert more["startingOffsets"] == "latest" and more["maxOffsetsPerTrigger"] == "1000"


def test_sink_options():
    expected = {"kafka.bootstrap.servers": "h:9092", "topic": "out"}
    assert kafka_sink_options("h:9092", "out") == expected


def test_socket_options():
    assert socket_options("localhost", 9999) == {"host": "localhost", "port": "9999"}


def test_socket_stream_is_declared_without_connecting(spark):
    lines = socket_lines(spark)
    assert lines.isStreaming and lines.dtypes == [("value", "string")]


def _kafka_ready(spark):
    try:
        kafka_records(spark, "localhost:9092", "t")
    except ConnectorMissing:
        return False
    return True


def test_source_without_connector(spark):
    if _kafka_ready(spark):
        pytest.skip("the Kafka connector is on the class path")
    with pytest.raises(ConnectorMissing, match="spark-sql-kafka"):
        kafka_records(spark, "localhost:9092", "invoices")


def test_sink_without_connector(spark, tmp_path):
    if _kafka_ready(spark):
        pytest.skip("the Kafka connector is on the class path")
    stream = spark.readStream.format("rate").load().selectExpr("string(value) as value")
    with pytest.raises(ConnectorMissing, match="spark-sql-kafka"):
        to_kafka(stream, "localhost:9092", "out", str(tmp_path / "ckpt"))


def test_record_columns_are_checked(spark):
    check_record(records(spark, []))
    check_record(spark.createDataFrame([], "value string"))
    with pytest.raises(ValueError, match="Key"):
        check_record(spark.createDataFrame([], "Key string, value string"))
    with pytest.raises(ValueError):
        check_record(spark.createDataFrame([], "key string"))
    with pytest.raises(ValueError, match="bigint"):
        check_record(spark.createDataFrame([], "key bigint, value string"))
