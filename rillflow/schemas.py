"""Field lists of the records this package reads and writes.

Each schema is an ordered ``{field: Spark SQL type}`` mapping, so that a job can ask for only the
fields it uses (``ddl(INVOICE, only=...)``): Spark does not narrow the schema of a JSON parse by
itself when several fields are taken from it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

# Names, types and order of the fields on the wire.

RECORD = {
    "key": "binary",
    "value": "binary",
    "topic": "string",
    "partition": "int",
    "offset": "bigint",
    "timestamp": "timestamp",
    "timestampType": "int",
}

INVOICE = {
    "InvoiceNumber": "string",
    "CreatedTime": "bigint",
    "StoreID": "string",
    "PosID": "string",
    "CashierID": "string",
    "CustomerType": "string",
    "CustomerCardNo": "string",
    "TotalAmount": "double",
    "NumberOfItems": "int",
    "PaymentMethod": "string",
    "CGST": "double",
    "SGST": "double",
    "CESS": "double",
    "DeliveryType": "string",
    "DeliveryAddress": (
        "struct<AddressLine: string, City: string, State: string, PinCode: string, "
        "ContactNumber: string>"
    ),
    "InvoiceLineItems": (
        "array<struct<ItemCode: string, ItemDescription: string, ItemPrice: double, "
        "ItemQty: int, TotalValue: double>>"
    ),
}

PUBLISHED_ITEM = {
    "InvoiceNumber": "string",
    "CreatedTime": "bigint",
    "StoreID": "string",
    "PosID": "string",
    "CustomerType": "string",
    "CustomerCardNo": "string",
    "DeliveryType": "string",
    "City": "string",
    "State": "string",
    "PinCode": "string",
    "ItemCode": "string",
    "ItemDescription": "string",
    "ItemPrice": "double",
    "ItemQty": "int",
    "TotalValue": "double",
}

# A published item that can be told from any other, for readers that may see it twice.
PUBLISHED_LINE = {**PUBLISHED_ITEM, "LineId": "string"}

NOTIFICATION = {
    "CustomerCardNo": "string",
    "TotalAmount": "double",
    "LoyaltyPoint": "double",
}

REWARD = {
    "CustomerCardNo": "string",
    "TotalPurchase": "double",
    "AggregatedRewards": "bigint",
}

TRADE = {
    "CreatedTime": "string",
    "Type": "string",
    "Amount": "int",
    "BrokerCode": "string",
}

SENSOR = {
    "CreatedTime": "string",
    "Reading": "double",
}

# Columns of the flat item tables, in output order.

FLAT_HEADER = [
    "InvoiceNumber",
    "CreatedTime",
    "StoreID",
    "PosID",
    "CustomerType",
    "PaymentMethod",
    "DeliveryType",
]
PUBLISHED_HEADER = [
    "InvoiceNumber",
    "CreatedTime",
    "StoreID",
    "PosID",
    "CustomerType",
    "CustomerCardNo",
    "DeliveryType",
]
PLACE = ["City", "State", "PinCode"]
ITEM = ["ItemCode", "ItemDescription", "ItemPrice", "ItemQty", "TotalValue"]

FLAT_ITEM = {
    name: {**INVOICE, **PUBLISHED_ITEM}[name] for name in [*FLAT_HEADER, *PLACE, *ITEM]
}

# Wire format of event times.

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def ddl(fields: Mapping[str, str], only: Iterable[str] | None = None) -> str:
    """DDL text of a schema, or of the fields in ``only`` (kept in schema order)."""
    if only is None:
        chosen = list(fields)
    else:
        wanted = set(only)
        unknown = wanted - set(fields)
        if unknown:
            raise ValueError(f"fields not in the schema: {sorted(unknown)}")
        chosen = [name for name in fields if name in wanted]
    return ", ".join(f"{name} {fields[name]}" for name in chosen)


def avro_schema(fields: Mapping[str, str], record: str) -> str:
    """Avro record document for a flat schema; every field may be null."""
    avro_type = {"string": "string", "bigint": "long", "int": "int", "double": "double"}
    return json.dumps(
        {
            "type": "record",
            "name": record,
            "fields": [
                {"name": name, "type": [avro_type[kind], "null"]} for name, kind in fields.items()
            ],
        }
    )
