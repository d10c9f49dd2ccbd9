"""Random small inputs against plain Python loops."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import invoice, records
from rillflow.operators.aggregates import prime_rewards, word_count
from rillflow.plans.jobs import flat_items, sensor_windows, trade_windows

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MINUTE = 60


def seconds(text):
    parsed = datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
    return int((parsed - EPOCH).total_seconds())


def random_time(rng, around):
    start = datetime.strptime(around, "%Y-%m-%d")
    return (start + timedelta(seconds=rng.randrange(-6 * 3600, 6 * 3600))).strftime(
        "%Y-%m-%d %H:%M:%S"
    )


# Around the epoch, so that windows before it are aligned too, and around a leap day.
@pytest.mark.parametrize("around", ["1970-01-01", "2024-02-29"])
@pytest.mark.parametrize("width, slide", [(15, 5), (15, 15), (20, 6)])
def test_sensor_windows(spark, around, width, slide):
    rng = random.Random(f"{around} {width} {slide}")
    rows = [
        (rng.choice(["a", "b", None]), random_time(rng, around), rng.choice([None, rng.random()]))
        for _ in range(400)
    ]
    expected = {}
    for sensor, time, value in rows:
        at = seconds(time)
        start = at - at % (slide * MINUTE)
        while start > at - width * MINUTE:
            best = expected.setdefault((sensor, start), None)
            if value is not None and (best is None or value > best):
                expected[sensor, start] = value
            start -= slide * MINUTE
    wire = [(s, json.dumps({"CreatedTime": t, "Reading": v})) for s, t, v in rows]
    got = sensor_windows(records(spark, wire), f"{width} minutes", f"{slide} minutes")
    got = got.select("SensorID", F.unix_seconds("start"), F.unix_seconds("end"), "MaxReading")
    result = {(sensor, start): best for sensor, start, _, best in got.collect()}
    assert result == expected
    assert all(end - start == width * MINUTE for _, start, end, _ in got.collect())


def test_trade_windows(spark):
    rng = random.Random(3)
    rows = [
        (
            random_time(rng, "1970-01-01"),
            rng.choice(["BUY", "SELL", "buy", None]),
            rng.choice([None, rng.randrange(-50, 2_000_000_000)]),
        )
        for _ in range(500)
    ]
    sums = defaultdict(lambda: {"BUY": [], "SELL": []})
    for time, kind, amount in rows:
        window = sums[seconds(time) // (15 * MINUTE) * 15 * MINUTE]
        for side, values in window.items():
            value = amount if kind == side else 0
            if value is not None:
                values.append(value)
    expected = {
        start: tuple(sum(values) if values else None for values in window.values())
        for start, window in sums.items()
    }
    wire = [
        (None, json.dumps({"CreatedTime": t, "Type": k, "Amount": a, "BrokerCode": "x"}))
        for t, k, a in rows
    ]
    totals = trade_windows(records(spark, wire))
    got = totals.select(F.unix_seconds("start"), "TotalBuy", "TotalSell").collect()
    assert {start: (buy, sell) for start, buy, sell in got} == expected


def test_word_count(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("ab \t\né", k=rng.randrange(30))) for _ in range(300)]
    expected = Counter(word for line in lines for word in line.split(" "))
    counted = word_count(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert {row.value: row["count"] for row in counted.collect()} == expected


def test_prime_rewards(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice(["PRIME", "OTHER"]), rng.choice(["c", "d", None]), rng.uniform(-9, 9))
        for _ in range(500)
    ]
    points, purchase = Counter(), defaultdict(float)
    for kind, card, value in rows:
        if kind == "PRIME":
            points[card] += int(value * 2)
            purchase[card] += value
    items = spark.createDataFrame(
        rows, "CustomerType string, CustomerCardNo string, TotalValue double"
    )
    got = prime_rewards(items).collect()
    assert {row.CustomerCardNo: row.AggregatedRewards for row in got} == dict(points)
    for row in got:
        assert row.TotalPurchase == pytest.approx(purchase[row.CustomerCardNo])


def test_flat_items(spark):
    rng = random.Random(6)
    documents = [
        invoice(str(n), [rng.random() for _ in range(rng.randrange(5))]) for n in range(100)
    ]
    expected = sorted(
        (d["InvoiceNumber"], item["ItemCode"], item["TotalValue"])
        for d in documents
        for item in d["InvoiceLineItems"]
    )
    flat = flat_items(records(spark, [(d["InvoiceNumber"], json.dumps(d)) for d in documents]))
    got = flat.select("InvoiceNumber", "ItemCode", "TotalValue").collect()
    assert sorted(map(tuple, got)) == expected
