"""Small inputs for tests: records, and directories whose files arrive in a known order."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from rillflow.schemas import RECORD, ddl


def records(spark, pairs):
    """``(key, value)`` text pairs as keyed records."""
    rows = [
        tuple(None if part is None else bytearray(part, "utf-8") for part in pair) for pair in pairs
    ]
    return spark.createDataFrame(rows, "key binary, value binary")


def reading(time, value, sensor="A"):
    return sensor, json.dumps({"CreatedTime": f"2019-02-05 {time}", "Reading": value})


def trade(time, kind, amount):
    fields = {"CreatedTime": f"2019-02-05 {time}", "Type": kind, "Amount": amount}
    return None, json.dumps({**fields, "BrokerCode": "B7"})


def land_records(spark, folder, number, pairs):
    """One parquet file of records, with a modification time that follows its number."""
    part = os.path.join(folder, f"landing-{number}")
    full = records(spark, pairs)
    for name, kind in RECORD.items():
        if name not in ("key", "value"):
            full = full.withColumn(name, F.lit(None).cast(kind))
    full.select(*RECORD).coalesce(1).write.parquet(part)
    for name in os.listdir(part):
        if name.endswith(".parquet"):
            os.utime(os.path.join(part, name), (1_600_000_000 + number * 10,) * 2)


def replay(spark, folder):
    """All landed files as a stream, one file per batch."""
    reader = spark.readStream.schema(ddl(RECORD)).option("maxFilesPerTrigger", 1)
    return reader.parquet(os.path.join(folder, "landing-*"))


def invoice(number, items, amount=10.0, card="c", kind="PRIME"):
    lines = [
        {
            "ItemCode": str(i),
            "ItemDescription": f"item {i}",
            "ItemPrice": 1.5,
            "ItemQty": 2,
            "TotalValue": value,
        }
        for i, value in enumerate(items)
    ]
    return {
        "InvoiceNumber": number,
        "CreatedTime": 1_549_360_887_000,
        "StoreID": "S1",
        "PosID": "P1",
        "CashierID": "C1",
        "CustomerType": kind,
        "CustomerCardNo": card,
        "TotalAmount": amount,
        "NumberOfItems": len(lines),
        "PaymentMethod": "CARD",
        "DeliveryType": "TAKEAWAY",
        "DeliveryAddress": {"AddressLine": "a", "City": "b", "State": "s", "PinCode": "1"},
        "InvoiceLineItems": lines,
    }


def land_json(folder, number, documents):
    """One JSON file, with a modification time that follows its number."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"in-{number}.json")
    with open(path, "w") as out:
        out.writelines(json.dumps(document) + "\n" for document in documents)
    os.utime(path, (1_600_000_000 + number * 10,) * 2)


def clock(rows, *values):
    """Window rows as ``(HH:MM, HH:MM, values...)``, sorted."""
    return sorted(
        (f"{row.start:%H:%M}", f"{row.end:%H:%M}", *(row[value] for value in values))
        for row in rows
    )
