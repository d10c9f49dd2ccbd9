from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import records
from rillflow.functions.codecs import (
    ConnectorMissing,
    decode_avro,
    decode_json,
    encode_avro,
    encode_json,
)
from rillflow.operators.invoices import loyalty_notifications
from rillflow.plans.jobs import (
    card_rewards,
    flat_items,
    item_records,
    notifications,
    sensor_windows,
    trade_windows,
)
from rillflow.schemas import INVOICE, PUBLISHED_ITEM, avro_schema, ddl
from rillflow.streaming.runner import finish
from rillflow.streaming.sinks import AVAILABLE_NOW, to_json_files

SHORT = {
    "InvoiceNumber": "string",
    "TotalAmount": "double",
    "CustomerCardNo": "string",
    "InvoiceLineItems": "array<struct<ItemCode: string, ItemQty: int>>",
}
MIXED = [
    ("a", "not json"),
    (
        "b",
        '{"InvoiceNumber":"1","TotalAmount":10.5,"CustomerCardNo":"c",'
        '"InvoiceLineItems":[{"ItemCode":"x","ItemQty":1},{"ItemCode":"y","ItemQty":2}]}',
    ),
    ("c", '{"InvoiceNumber":"2","InvoiceLineItems":[]}'),
    ("d", '{"InvoiceNumber":"3"}'),
    ("e", '{"InvoiceNumber":"4","InvoiceLineItems":[{"ItemCode":"z","ItemQty":"x"}]}'),
    ("f", None),
]


def test_malformed_values(spark):
    rows = {row.id: row for row in decode_json(records(spark, MIXED), SHORT, key_as="id").collect()}
    assert list(rows["a"])[1:] == [None] * 4
    assert rows["b"].TotalAmount == 10.5 and len(rows["b"].InvoiceLineItems) == 2
    assert rows["c"].InvoiceLineItems == []
    assert rows["d"].InvoiceLineItems is None
    assert rows["e"].InvoiceLineItems[0].ItemCode == "z"
    assert rows["e"].InvoiceLineItems[0].ItemQty is None
    assert list(rows["f"])[1:] == [None] * 4


def test_explode_drops_invoices_without_items(spark):
    decoded = decode_json(records(spark, MIXED), SHORT)
    counts = decoded.select("InvoiceNumber", F.explode("InvoiceLineItems")).groupBy("InvoiceNumber")
    assert {row.InvoiceNumber: row["count"] for row in counts.count().collect()} == {"1": 2, "4": 1}


def test_notifications_of_malformed_values(spark):
    notes = loyalty_notifications(decode_json(records(spark, MIXED), SHORT)).collect()
    assert sorted(((n.key or ""), n.value) for n in notes) == [
        ("", "{}"),
        ("", "{}"),
        ("1", '{"CustomerCardNo":"c","TotalAmount":10.5,"LoyaltyPoint":2.1}'),
        ("2", "{}"),
        ("3", "{}"),
        ("4", "{}"),
    ]


def test_drop_malformed(spark):
    kept = decode_json(records(spark, MIXED), SHORT, drop_malformed=True)
    assert sorted(row.InvoiceNumber for row in kept.collect()) == ["1", "2", "3", "4"]


def _parses(df):
    """How often the physical plan parses JSON."""
    return df._jdf.queryExecution().executedPlan().toString().count("from_json(")


def test_each_record_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "stored")
    records(spark, MIXED).write.parquet(path)
    stored = spark.read.parquet(path)
    assert _parses(flat_items(stored)) == 1
    assert _parses(notifications(stored)) == 1
    assert _parses(item_records(stored, "json")) == 1
    assert _parses(card_rewards(stored, "json")) == 1
    assert _parses(trade_windows(stored)) == 1
    assert _parses(sensor_windows(stored)) == 1


def test_decoded_records_are_observed(spark, tmp_path):
    path = str(tmp_path / "stored")
    records(spark, MIXED).write.parquet(path)
    stream = spark.readStream.schema("key binary, value binary").parquet(path)
    decoded = decode_json(stream, SHORT, metric="seen", drop_malformed=True)
    query = to_json_files(
        decoded, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger=AVAILABLE_NOW
    )
    finish(query, 120)
    assert query.recentProgress[0].observedMetrics["seen"].asDict() == {"rows": 6, "blank": 2}
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_struct_and_narrow_decode(spark):
    nested = decode_json(records(spark, MIXED), SHORT, only=["TotalAmount"], expand=False)
    assert nested.schema.simpleString() == "struct<value:struct<TotalAmount:double>>"
    assert nested.where("value.TotalAmount = 10.5").count() == 1
    with pytest.raises(ValueError, match="Nothing"):
        ddl(SHORT, only=["Nothing"])


def test_narrow_decode_equals_full_decode(spark):
    narrow = decode_json(records(spark, MIXED), SHORT, only=["InvoiceNumber", "TotalAmount"])
    full = decode_json(records(spark, MIXED), SHORT).select("InvoiceNumber", "TotalAmount")
    assert sorted(map(str, narrow.collect())) == sorted(map(str, full.collect()))


def test_encode_whole_row_and_chosen_fields(spark):
    df = spark.createDataFrame([(1, "x", None), (None, None, None)], "a int, b string, c double")
    rows = encode_json(df, "a").collect()
    assert [(row.key, row.value) for row in rows] == [("1", '{"a":1,"b":"x"}'), (None, "{}")]
    assert encode_json(df, "a", ["b"]).first().value == '{"b":"x"}'


def test_round_trip_keeps_every_field(spark):
    row = {name: None for name in PUBLISHED_ITEM} | {"InvoiceNumber": "7", "TotalValue": 0.1}
    df = spark.createDataFrame([row], ddl(PUBLISHED_ITEM))
    back = decode_json(encode_json(df, "InvoiceNumber"), PUBLISHED_ITEM)
    assert back.columns == list(PUBLISHED_ITEM)
    assert back.first().asDict() == row


def test_avro_schema_of_published_items():
    fields = json.loads(avro_schema(PUBLISHED_ITEM, "PublishedItem"))["fields"]
    assert [field["name"] for field in fields] == list(PUBLISHED_ITEM)
    kinds = {field["name"]: field["type"] for field in fields}
    assert kinds["InvoiceNumber"] == ["string", "null"]
    assert kinds["CreatedTime"] == ["long", "null"]
    assert kinds["ItemQty"] == ["int", "null"]
    assert kinds["TotalValue"] == ["double", "null"]


def _avro_ready(spark):
    try:
        encode_avro(spark.range(1), "id").schema
    except ConnectorMissing:
        return False
    return True


def test_avro_is_handed_its_schema_and_mode(spark, monkeypatch):
    from rillflow.functions import codecs

    seen = {}

    def written(value, schema=""):
        seen["to"] = schema
        return F.to_json(value)

    def read(value, schema, options=None):
        seen["from"] = schema, options
        return F.from_json(value.cast("string"), ddl(PUBLISHED_ITEM))

    monkeypatch.setattr(codecs, "to_avro", written)
    monkeypatch.setattr(codecs, "from_avro", read)
    schema = avro_schema(PUBLISHED_ITEM, "PublishedItem")
    item_records(records(spark, MIXED), "avro").schema
    assert seen["to"] == schema
    decode_avro(records(spark, MIXED), schema, drop_malformed=True).schema
    assert seen["from"] == (schema, {"mode": "PERMISSIVE"})


def test_avro_round_trip_or_clear_error(spark):
    schema = avro_schema(PUBLISHED_ITEM, "PublishedItem")
    items = decode_json(
        records(spark, [("1", '{"CustomerType":"PRIME","CustomerCardNo":"c","TotalValue":1.3}')]),
        PUBLISHED_ITEM,
    )
    if _avro_ready(spark):
        encoded = encode_avro(items, "InvoiceNumber")
        assert decode_avro(encoded, schema).collect() == items.collect()
        assert card_rewards(encoded).first().AggregatedRewards == 2
        return
    with pytest.raises(ConnectorMissing, match="spark-avro"):
        encode_avro(items, "InvoiceNumber")
    with pytest.raises(ConnectorMissing, match="spark-avro"):
        decode_avro(records(spark, []), schema)


def test_invoice_schema_parses(spark):
    assert len(spark.createDataFrame([], ddl(INVOICE)).schema) == 16
