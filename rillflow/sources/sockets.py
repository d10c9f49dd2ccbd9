"""Lines from a TCP peer. Not replayable: for trying things out, not for data that must be whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def socket_options(host: str, port: int) -> dict[str, str]:
    return {"host": host, "port": str(port)}


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """One row per received line, column ``value``."""
    return spark.readStream.format("socket").options(**socket_options(host, port)).load()
