"""Every registered query against its SQL, row by row, on whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from rillflow.plans.oracle import ORACLES
from rillflow.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def _comparable(value):
    return round(value, 9) if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(
        (tuple(_comparable(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, duck, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    answer = duck.execute(entry_points.oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    expected = _rows(columns, answer.fetchall())
    assert sorted(result.columns) == sorted(columns)
    assert expected
    assert _rows(result.columns, result.collect()) == expected


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["SensorID", "start", "end", "MaxReading"]
    assert result.count() > 0
