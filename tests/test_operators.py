from __future__ import annotations

import json

from helpers import clock, invoice, reading, records, trade
from rillflow.functions.expressions import with_event_time
from rillflow.operators.aggregates import prime_rewards, word_count
from rillflow.operators.invoices import flatten_invoices, published_items
from rillflow.operators.windows import trade_totals
from rillflow.plans.jobs import sensor_windows, trade_windows
from rillflow.schemas import FLAT_ITEM, INVOICE, PUBLISHED_ITEM, ddl

TRADES = [
    ("13:00:00", "BUY", 70),
    ("13:29:59", "SELL", 25),
    ("13:14:59", "SELL", 10),
    ("13:31:00", "BUY", 5),
    ("13:44:00", "BUY", 11),
    ("13:01:30", "BUY", 30),
]
READINGS = [
    ("21:02:00", 4.5),
    ("21:08:00", 7.25),
    ("21:21:00", -1.0),
    ("21:22:00", -3.5),
]


def test_trade_totals(spark):
    totals = trade_windows(records(spark, [trade(*row) for row in TRADES]))
    assert totals.dtypes[2:] == [("TotalBuy", "bigint"), ("TotalSell", "bigint")]
    assert clock(totals.collect(), "TotalBuy", "TotalSell") == [
        ("13:00", "13:15", 100, 10),
        ("13:15", "13:30", 0, 25),
        ("13:30", "13:45", 16, 0),
    ]


def test_sensor_max(spark):
    maxima = sensor_windows(records(spark, [reading(*row, sensor="roof") for row in READINGS]))
    assert maxima.columns == ["SensorID", "start", "end", "MaxReading"]
    rows = maxima.collect()
    assert {row.SensorID for row in rows} == {"roof"}
    assert clock(rows, "MaxReading") == [
        ("20:50", "21:05", 4.5),
        ("20:55", "21:10", 7.25),
        ("21:00", "21:15", 7.25),
        ("21:05", "21:20", 7.25),
        ("21:10", "21:25", -1.0),
        ("21:15", "21:30", -1.0),
        ("21:20", "21:35", -1.0),
    ]


def test_other_types_and_null_amounts(spark):
    rows = [
        trade("10:00:00", "buy", 5),
        trade("10:01:00", None, 5),
        trade("10:02:00", "BUY", None),
        trade("10:20:00", "BUY", None),
    ]
    totals = clock(trade_windows(records(spark, rows)).collect(), "TotalBuy", "TotalSell")
    # Another or no type counts as 0 on both sides; a matching type without amount is no value.
    assert totals == [("10:00", "10:15", 0, 0), ("10:15", "10:30", None, 0)]


def test_rows_without_event_time_enter_no_window(spark):
    rows = [
        trade("10:00:00", "BUY", 1),
        (None, '{"CreatedTime":"2019/02/05","Type":"BUY","Amount":9}'),
        (None, "broken"),
        (None, None),
    ]
    totals = clock(trade_windows(records(spark, rows)).collect(), "TotalBuy", "TotalSell")
    assert totals == [("10:00", "10:15", 1, 0)]


def test_window_bounds_are_half_open(spark):
    rows = [trade("10:14:59", "BUY", 1), trade("10:15:00", "BUY", 2)]
    totals = clock(trade_windows(records(spark, rows)).collect(), "TotalBuy", "TotalSell")
    assert totals == [("10:00", "10:15", 1, 0), ("10:15", "10:30", 2, 0)]


def test_windows_start_on_the_epoch_in_any_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        timed = with_event_time(
            spark.createDataFrame(
                [("2019-02-05 10:05:00", "BUY", 1)], "CreatedTime string, Type string, Amount int"
            )
        )
        starts = trade_totals(timed).selectExpr("unix_seconds(start) % 900 as rest").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert starts.rest == 0


def test_word_count_keeps_empty_tokens(spark):
    lines = spark.createDataFrame([("a  b ",), ("",), (None,), ("a",)], "value string")
    counted = word_count(lines)
    assert counted.columns == ["value", "count"]
    assert {row.value: row["count"] for row in counted.collect()} == {"a": 2, "b": 1, "": 3}


def test_rewards_cut_points_per_line(spark):
    rows = [
        ("PRIME", "c", 1.3),
        ("PRIME", "c", 1.3),
        ("PRIME", "c", None),
        ("PRIME", "d", -1.495),
        ("PRIME", None, 2.0),
        ("PRIME", "n", float("nan")),
        ("OTHER", "c", 100.0),
        (None, "c", 100.0),
    ]
    items = spark.createDataFrame(
        rows, "CustomerType string, CustomerCardNo string, TotalValue double"
    )
    rewards = prime_rewards(items)
    assert rewards.dtypes[1:] == [("TotalPurchase", "double"), ("AggregatedRewards", "bigint")]
    got = {card: (purchase, points) for card, purchase, points in rewards.collect()}
    assert got["c"] == (2.6, 4)
    assert got["d"] == (-1.495, -2)
    assert got[None] == (2.0, 4)
    assert got["n"][1] is None
    assert set(got) == {"c", "d", "n", None}


def test_reward_points_beyond_32_bits(spark):
    items = spark.createDataFrame(
        [("PRIME", "c", 3e9), ("PRIME", "c", 3e9)],
        "CustomerType string, CustomerCardNo string, TotalValue double",
    )
    assert prime_rewards(items).first().AggregatedRewards == 12_000_000_000


def _invoices(spark, documents):
    lines = spark.createDataFrame([(json.dumps(d),) for d in documents], "value string")
    return lines.selectExpr(f"from_json(value, '{ddl(INVOICE)}') as v").select("v.*")


def test_flatten(spark):
    nested = _invoices(spark, [invoice("1", [1.0, 2.0]), invoice("2", [])])
    flat = flatten_invoices(nested)
    assert flat.dtypes == list(FLAT_ITEM.items())
    chosen = flat.select("InvoiceNumber", "City", "ItemCode", "TotalValue")
    assert [tuple(row) for row in chosen.collect()] == [
        ("1", "b", "0", 1.0),
        ("1", "b", "1", 2.0),
    ]
    assert published_items(nested).dtypes == list(PUBLISHED_ITEM.items())


def test_null_line_item_keeps_its_row(spark):
    document = invoice("1", [1.0]) | {"InvoiceLineItems": [None]}
    row = flatten_invoices(_invoices(spark, [document])).first()
    assert row.InvoiceNumber == "1" and row.ItemCode is None and row.TotalValue is None


def test_missing_address_gives_null_place(spark):
    document = {k: v for k, v in invoice("1", [1.0]).items() if k != "DeliveryAddress"}
    row = flatten_invoices(_invoices(spark, [document])).first()
    assert (row.City, row.State, row.PinCode) == (None, None, None)
