"""Invoices to line items and to loyalty notifications. Row by row, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.codecs import encode_json
from rillflow.functions.expressions import loyalty_points
from rillflow.schemas import FLAT_HEADER, ITEM, NOTIFICATION, PLACE, PUBLISHED_HEADER

# What each transform reads from an invoice: pass it to ``decode_json(only=...)``.
FLATTEN_NEEDS = [*FLAT_HEADER, "DeliveryAddress", "InvoiceLineItems"]
PUBLISH_NEEDS = [*PUBLISHED_HEADER, "DeliveryAddress", "InvoiceLineItems"]
LOYALTY_NEEDS = ["InvoiceNumber", "CustomerCardNo", "TotalAmount"]


def _line_items(
    invoices: DataFrame, header: Iterable[str], record_id: str | None = None
) -> DataFrame:
    # A missing list explodes like an empty one. Spelt out, because for a bare column Spark adds a
    # filter on its size and pushes that, with the parse of the whole record inside, below a decode.
    items = F.coalesce("InvoiceLineItems", F.array())
    lines = invoices.select(
        *header,
        *(f"DeliveryAddress.{name}" for name in PLACE),
        *([] if record_id is None else [record_id]),
        F.explode(items).alias("LineItem") if record_id is None
        else F.posexplode(items).alias("LineNumber", "LineItem"),
    )
    line_id = [] if record_id is None else [F.concat_ws("-", record_id, "LineNumber").alias("LineId")]
    return lines.select(*header, *PLACE, *(f"LineItem.{name}" for name in ITEM), *line_id)


def flatten_invoices(invoices: DataFrame) -> DataFrame:
    """One row per line item; an invoice without items gives none."""
    return _line_items(invoices, FLAT_HEADER)


def published_items(invoices: DataFrame, record_id: str | None = None) -> DataFrame:
    """Line items as they are published: with the customer's card, without the payment method.

    ``record_id`` names a column that tells invoice records apart; it adds a ``LineId`` to each item.
    """
    return _line_items(invoices, PUBLISHED_HEADER, record_id)


def loyalty_notifications(invoices: DataFrame, rate: float = 0.2) -> DataFrame:
    """``key, value`` records: the points an invoice earns, under its number."""
    points = invoices.withColumn("LoyaltyPoint", loyalty_points(F.col("TotalAmount"), rate))
    return encode_json(points, "InvoiceNumber", NOTIFICATION)
