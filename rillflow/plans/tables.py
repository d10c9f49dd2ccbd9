"""Records made from the star-schema and event tables, in the shapes the jobs read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.schemas import INVOICE, ITEM, TIME_FORMAT

# Line items one invoice record holds at about this most: a record is one JSON text in memory.
PAGE_ITEMS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record(key: Column, *fields: Column) -> list[Column]:
    return [
        key.cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*fields)).cast("binary").alias("value"),
    ]


def sensor_records(
    events: DataFrame, time: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Each event as a reading of the sensor named by its type, beside the columns to ``keep``."""
    time = F.date_format("ts", TIME_FORMAT) if time is None else time
    fields = time.alias("CreatedTime"), F.col("value").alias("Reading")
    return events.select(*keep, *_record(F.col("event_type"), *fields))


def trade_records(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Purchases as buys, errors as sells, the rest as trades of a type of their own."""
    kind = (
        F.when(F.col("event_type") == "purchase", "BUY")
        .when(F.col("event_type") == "error", "SELL")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        *keep,
        *_record(
            F.col("event_id"),
            F.date_format("ts", TIME_FORMAT).alias("CreatedTime"),
            kind.alias("Type"),
            F.round(F.col("value") * 100).cast("int").alias("Amount"),
            F.col("user_id").cast("string").alias("BrokerCode"),
        )
    )


def _header_fields() -> list[Column]:
    """Invoice fields that come from the order and its customer."""
    address = F.struct(
        F.col("c_name").alias("AddressLine"),
        F.col("n_name").alias("City"),
        F.col("r_name").alias("State"),
        F.col("c_nationkey").cast("string").alias("PinCode"),
        F.lit(None).cast("string").alias("ContactNumber"),
    )
    store = F.concat(F.lit("STR"), F.col("c_nationkey").cast("string"))
    return [
        F.col("o_orderkey").cast("string").alias("InvoiceNumber"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("CreatedTime"),
        store.alias("StoreID"),
        F.concat(F.lit("POS"), F.col("o_orderstatus")).alias("PosID"),
        F.lit(None).cast("string").alias("CashierID"),
        F.col("c_mktsegment").alias("CustomerType"),
        F.col("o_custkey").cast("string").alias("CustomerCardNo"),
        F.col("o_totalprice").alias("TotalAmount"),
        F.lit(None).cast("int").alias("NumberOfItems"),
        F.col("o_orderpriority").alias("PaymentMethod"),
        (F.col("o_totalprice") * 0.025).alias("CGST"),
        (F.col("o_totalprice") * 0.025).alias("SGST"),
        (F.col("o_totalprice") * 0.00125).alias("CESS"),
        F.when(F.col("o_orderstatus") == "O", "HOME-DELIVERY")
        .otherwise("TAKEAWAY")
        .alias("DeliveryType"),
        address.alias("DeliveryAddress"),
    ]


def _line_value() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _line_fields() -> list[Column]:
    return [
        F.col("l_partkey").cast("string").alias("ItemCode"),
        F.col("p_name").alias("ItemDescription"),
        F.col("l_extendedprice").alias("ItemPrice"),
        F.col("l_quantity").cast("int").alias("ItemQty"),
        _line_value().alias("TotalValue"),
    ]


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, nation and region."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    place = place.select("n_nationkey", "n_name", "r_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", *_header_fields())
    )


def _with_part(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")


def large_orders(lineitem: DataFrame, page_items: int) -> DataFrame:
    """``l_orderkey, pages`` of the orders whose line items do not fit one record."""
    sizes = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("items"))
    pages = F.ceil(F.col("items") / page_items).alias("pages")
    return sizes.where(F.col("items") > page_items).select("l_orderkey", pages)


def invoices(spark: SparkSession, sf_dir: str, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Nested invoices, and ``first_page``: each order with its customer and its line items.

    An order too large for one record is spread over several with the same header, so that no task
    ever holds all items of one order: both sides are grouped and joined by order and page.
    ``first_page`` marks one record of each order; whatever must happen once per order goes by it.
    An order without items keeps its invoice. Which orders are large depends on their own items
    only, so results are the same at any size.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    # Broadcast: at most one row for every ``page_items`` line items. Joined by shuffles, it would send
    # all orders and all line items through one more each.
    large = F.broadcast(large_orders(lineitem, page_items))
    pages = F.coalesce(F.col("pages"), F.lit(1))
    # Numbered at the scan: that spreads copies of one row too, and a repeated task gives the same
    # numbers again. Hashed, since the rows of one order may lie a regular step apart.
    numbered = lineitem.withColumn("row_no", F.xxhash64(F.monotonically_increasing_id()))
    items = (
        _with_part(numbered, table(spark, sf_dir, "part"))
        .join(large, "l_orderkey", "left")
        .select("l_orderkey", F.pmod("row_no", pages).alias("page"), *_line_fields())
        .repartition("l_orderkey", "page")
        .groupBy("l_orderkey", "page")
        .agg(F.collect_list(F.struct(*ITEM)).alias("InvoiceLineItems"))
    )
    headers = (
        _headers(spark, sf_dir)
        .join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .drop("l_orderkey")
        .withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), pages - 1)))
    )
    same = (F.col("o_orderkey") == F.col("l_orderkey")) & (headers.page == items.page)
    first = (headers.page == 0).alias(FIRST_PAGE)
    return headers.join(items, same, "left").select(*INVOICE, first)


FIRST_PAGE = "first_page"


def invoice_records(
    spark: SparkSession, sf_dir: str, page_items: int = PAGE_ITEMS, also: Sequence[Column] = ()
) -> DataFrame:
    """Nested invoices as keyed JSON records, with ``first_page`` and ``also`` beside them."""
    nested = invoices(spark, sf_dir, page_items)
    record = _record(F.col("InvoiceNumber"), *(F.col(name) for name in INVOICE))
    return nested.select(*record, FIRST_PAGE, *also)


def order_records(orders: DataFrame) -> DataFrame:
    """Orders as invoice records without line items, enough for notifications."""
    return orders.select(
        *_record(
            F.col("o_orderkey"),
            F.col("o_orderkey").cast("string").alias("InvoiceNumber"),
            F.col("o_custkey").cast("string").alias("CustomerCardNo"),
            F.col("o_totalprice").alias("TotalAmount"),
            F.col("o_orderpriority").alias("PaymentMethod"),
        )
    )


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as published records, with the fields that rewards are computed from.

    Orders meet their customers first, so that the line items, the largest table, are shuffled once
    only. Where one order or customer holds much of the data, the adaptive planner splits it.
    """
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    sales = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return lineitem.join(sales, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_record(
            F.col("o_orderkey"),
            F.col("o_orderkey").cast("string").alias("InvoiceNumber"),
            F.col("c_mktsegment").alias("CustomerType"),
            F.col("c_custkey").cast("string").alias("CustomerCardNo"),
            _line_value().alias("TotalValue"),
        )
    )
