"""The shape of the physical plans: what is read, what is shuffled, what stays in the JVM."""

from __future__ import annotations

import re

import pytest

from rillflow.functions.codecs import decode_json
from rillflow.operators.invoices import flatten_invoices
from rillflow.plans import queries, tables
from rillflow.schemas import INVOICE
from rillflow.streaming.sinks import latest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePart)", plan(df)))


READS = {
    "word_count": ["text"],
    "json_decode": ["event_id", "props"],
    "trade_totals": ["event_type", "ts", "value"],
    "sensor_max": ["event_type", "ts", "value"],
}


@pytest.mark.parametrize("name", list(READS))
def test_only_used_columns_are_read(spark, name):
    df = queries.QUERIES[name](spark, SF)
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    read = {
        field
        for i in range(leaves.size())
        for field in leaves.apply(i).requiredSchema().fieldNames()
    }
    assert set(READS[name]) <= read <= {*READS[name], "user_id"}


@pytest.mark.parametrize(
    "name, count",
    [
        ("word_count", 1),
        ("trade_totals", 1),
        ("sensor_max", 1),
        ("json_decode", 0),
        ("loyalty_notifications", 0),
        ("prime_rewards", 1),
    ],
)
def test_shuffles(spark, name, count):
    assert shuffles(queries.QUERIES[name](spark, SF)) == count


@pytest.mark.parametrize("name", ["word_count", "trade_totals", "sensor_max", "prime_rewards"])
def test_aggregation_starts_before_the_shuffle(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "partial_" in text.split("Exchange hashpartitioning", 1)[1]


TABLE_QUERIES = [
    "word_count",
    "json_decode",
    "decode_malformed",
    "trade_totals",
    "sensor_max",
    "sensor_max_undated",
    "invoice_flatten",
    "published_items",
    "loyalty_notifications",
    "prime_rewards",
    "rewards_encoded",
]


@pytest.mark.parametrize("name", TABLE_QUERIES)
def test_no_python_in_the_plan(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_flattening_stored_invoices_shuffles_nothing(spark, tmp_path):
    path = str(tmp_path / "records")
    tables.invoice_records(spark, SF).write.parquet(path)
    flat = flatten_invoices(decode_json(spark.read.parquet(path), INVOICE))
    assert shuffles(flat) == 0


def test_line_items_are_shuffled_once_to_be_nested(spark):
    text = plan(tables.invoices(spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, page", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(o_orderkey#\d+L, page", text)) == 1


def test_newest_rows_are_found_by_hashing(spark):
    log = spark.range(10).selectExpr("id % 2 as key", "id as total", "int(id) as batch_id")
    text = plan(latest(log, ["key"]))
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert {row.key: row.total for row in latest(log, ["key"]).collect()} == {0: 8, 1: 9}
