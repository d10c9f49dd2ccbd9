"""Results stay whole when one key holds a third of all rows, copies included."""

from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F

from rillflow.operators.aggregates import prime_rewards
from rillflow.plans import jobs, tables
from rillflow.functions.codecs import decode_json
from rillflow.plans.queries import (
    SIDE_BY_SIDE,
    SLOTS,
    q_fan_out_notifications,
    q_fan_out_single_read_notifications,
    q_invoice_flatten,
    q_loyalty_notifications,
    q_record_flatten,
)
from rillflow.schemas import INVOICE, NOTIFICATION
from rillflow.session import settings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The small tables with half as many line items again: all of order 7, most of them copies."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in ("orders", "customer", "part", "nation", "region"):
        tables.table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    lineitem = tables.table(spark, SF, "lineitem")
    one = lineitem.limit(1).withColumn("l_orderkey", F.lit(7).cast("bigint"))
    copies = one.crossJoin(spark.range(2500)).drop("id")
    others = lineitem.limit(500).withColumn("l_orderkey", F.lit(7).cast("bigint"))
    lineitem.union(copies).union(others).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_a_large_order_is_spread_over_records(spark, skewed):
    nested = tables.invoices(spark, skewed, page_items=100).where("InvoiceNumber = '7'")
    sizes = [row.n for row in nested.select(F.size("InvoiceLineItems").alias("n")).collect()]
    total = tables.table(spark, skewed, "lineitem").where("l_orderkey = 7").count()
    assert sum(sizes) == total
    assert len(sizes) == -(-total // 100)
    assert max(sizes) < 200
    header = nested.select(*(name for name in INVOICE if name != "InvoiceLineItems"))
    assert header.distinct().count() == 1


def test_paging_changes_no_item(spark, skewed):
    paged = jobs.flat_items(tables.invoice_records(spark, skewed, page_items=100), metric="paged")
    whole = q_invoice_flatten(spark, skewed)
    assert paged.exceptAll(whole).isEmpty() and whole.exceptAll(paged).isEmpty()
    lineitem = tables.table(spark, skewed, "lineitem")
    orders = tables.table(spark, skewed, "orders")
    known = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    assert paged.count() == known.count()


def test_orders_without_items_keep_their_invoice(spark, skewed):
    nested = tables.invoices(spark, skewed, page_items=100)
    orders = tables.table(spark, skewed, "orders").count()
    assert nested.select("InvoiceNumber").distinct().count() == orders
    empty = nested.where(F.col("InvoiceLineItems").isNull()).count()
    lineitem = tables.table(spark, skewed, "lineitem").select("l_orderkey").distinct()
    without = tables.table(spark, skewed, "orders").join(
        lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"
    )
    assert empty == without.count() > 0


def test_large_orders_depend_on_their_own_items_only(spark, skewed):
    lineitem = tables.table(spark, skewed, "lineitem")
    found = tables.large_orders(lineitem, 100).collect()
    assert [row.l_orderkey for row in found] == [7]


def _notes(records):
    notes = jobs.notifications(records, metric="paged_notes", first_page=tables.FIRST_PAGE)
    return decode_json(notes, NOTIFICATION, key_as="InvoiceNumber")


@pytest.mark.parametrize("page_items", [3, 100])
def test_paging_changes_no_notification(spark, skewed, page_items):
    paged = _notes(tables.invoice_records(spark, skewed, page_items))
    whole = q_loyalty_notifications(spark, skewed)
    assert paged.exceptAll(whole).isEmpty() and whole.exceptAll(paged).isEmpty()


def test_fan_out_of_paged_invoices_notifies_once(spark, skewed, monkeypatch):
    few = partial(tables.invoice_records, page_items=3)
    monkeypatch.setattr(tables, "invoice_records", few)
    whole = q_loyalty_notifications(spark, skewed)
    for query in (q_fan_out_notifications, q_fan_out_single_read_notifications):
        paged = query(spark, skewed)
        assert paged.exceptAll(whole).isEmpty() and whole.exceptAll(paged).isEmpty()


def test_rows_a_regular_step_apart_spread_over_pages(spark):
    rows = spark.range(0, 40_000, 4).withColumn("row_no", F.xxhash64("id"))
    sizes = [r["count"] for r in rows.groupBy(F.pmod("row_no", F.lit(4))).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_hot_card_reaches_the_shuffle_as_one_row_per_task(spark):
    items = spark.range(0, 300_000, numPartitions=6).select(
        F.lit("PRIME").alias("CustomerType"),
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.col("id").cast("string"))
        .alias("CustomerCardNo"),
        F.lit(1.5).alias("TotalValue"),
    )
    rewards = prime_rewards(items).where("CustomerCardNo = 'hot'").first()
    assert (rewards.TotalPurchase, rewards.AggregatedRewards) == (150_000.0, 300_000)
    plan = prime_rewards(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("partial_sum")


def test_the_list_of_large_orders_moves_no_other_table(spark, skewed):
    """Without broadcasts of Spark's own choice only the list is sent round, to both of its joins."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = tables.invoices(spark, skewed)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2


def test_staged_slots_are_written_unsorted(spark, skewed):
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "0")
    with settings(spark, SIDE_BY_SIDE):
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= SLOTS
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert q_record_flatten(spark, skewed).exceptAll(q_invoice_flatten(spark, skewed)).isEmpty()
