from __future__ import annotations

import json
import os
from functools import partial

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import clock, invoice, land_json, land_records, reading, records, replay, trade
from rillflow.functions.codecs import decode_json
from rillflow.operators.aggregates import word_count
from rillflow.operators.invoices import flatten_invoices
from rillflow.plans import jobs
from rillflow.schemas import FLAT_ITEM, INVOICE, PUBLISHED_ITEM, RECORD, TIME_FORMAT, ddl
from rillflow.sources.files import json_dir, replay_records, stored_records, text_lines
from rillflow.streaming.fanout import fan_out
from rillflow.streaming.runner import finish, wait_for_any
from rillflow.streaming.sinks import (
    AVAILABLE_NOW,
    latest,
    read_snapshot,
    to_console,
    to_json_files,
    to_record_files,
    to_snapshots,
    to_update_log,
)


def lines_dir(tmp_path, *files):
    folder = tmp_path / "lines"
    folder.mkdir(exist_ok=True)
    for number, text in enumerate(files):
        path = folder / f"{number}.txt"
        path.write_text(text)
        os.utime(path, (1_600_000_000 + number * 10,) * 2)
    return str(folder)


def names(folder):
    if not os.path.isdir(folder):
        return []
    found = (name for _, _, files in os.walk(folder) for name in files)
    return sorted(name for name in found if name.startswith("in-"))


def test_word_count_snapshots(spark, tmp_path):
    folder = lines_dir(tmp_path, "a b\na\n", "b b c\n", "c\n")
    lines = text_lines(spark, folder, max_files=1)
    assert lines.columns == ["value"]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    sink = partial(to_snapshots, path=out)
    finish(jobs.count_words(lines, checkpoint, sink, None, AVAILABLE_NOW), 120)
    counted = read_snapshot(spark, out)
    assert counted.columns == ["value", "count"]
    assert {row.value: row["count"] for row in counted.collect()} == {"a": 2, "b": 3, "c": 2}
    kept = spark.read.parquet(out).select("batch_id").distinct().collect()
    assert sorted(row.batch_id for row in kept) == [1, 2]


def test_console_prints_first_rows_only(spark, tmp_path, capsys):
    folder = lines_dir(tmp_path, "a b c d e\n")
    query = to_console(
        word_count(text_lines(spark, folder)), str(tmp_path / "ckpt"), "complete",
        trigger=AVAILABLE_NOW, rows=2,
    )
    finish(query, 120)
    printed = capsys.readouterr().out
    assert "Batch 0" in printed and "|b " in printed and "|c " not in printed


def _landed(spark, folder, number, rows):
    """A file of rows under the next arrival."""
    rows.coalesce(1).write.parquet(f"{folder}/landing-{number}")
    for name in os.listdir(f"{folder}/landing-{number}"):
        os.utime(f"{folder}/landing-{number}/{name}", (1_600_000_000 + 10 * number,) * 2)


CONSOLE_JOBS = {
    "words": (
        lambda s, **k: jobs.count_words(s.select(F.col("value").cast("string").alias("value")), **k),
        lambda r: word_count(r.select(F.col("value").cast("string").alias("value"))),
        ["value"],
    ),
    "trades": (jobs.total_trades, jobs.trade_windows, ["start", "end"]),
    "sensors": (jobs.track_sensors, jobs.sensor_windows, ["SensorID", "start", "end"]),
}


@pytest.mark.parametrize("kind", list(CONSOLE_JOBS))
def test_default_sinks_commit_all_state(spark, tmp_path, capsys, kind):
    """Three batches of many groups into the console, a restart, and the state that is left."""
    start, table, keys = CONSOLE_JOBS[kind]
    minutes = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 240), TIME_FORMAT)
    value = {
        "words": F.concat(F.lit("w"), F.col("id") % 1000),
        "trades": F.to_json(F.struct(minutes.alias("CreatedTime"), F.lit("BUY").alias("Type"),
                                     F.col("id").cast("int").alias("Amount"))),
        "sensors": F.to_json(F.struct(minutes.alias("CreatedTime"),
                                      F.col("id").cast("double").alias("Reading"))),
    }[kind]
    rows = spark.range(4000).select(
        (F.col("id") % 7).cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        "id",
    )
    for name, field in RECORD.items():
        if name not in ("key", "value"):
            rows = rows.withColumn(name, F.lit(None).cast(field))
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        common = {"checkpoint": checkpoint, "name": None, "trigger": AVAILABLE_NOW}
        landed = [rows.where(f"id div 1000 = {n}").drop("id") for n in range(4)]
        for n in range(3):
            _landed(spark, folder, n, landed[n])
        stream = lambda: replay_records(spark, f"{folder}/landing-*", 1)
        finish(start(stream(), **common), 120)
        printed = capsys.readouterr().out
        assert all(f"Batch {n}" in printed for n in range(3))
        _landed(spark, folder, 3, landed[3])
        log = str(tmp_path / "log")
        mode = "complete" if kind == "words" else "update"
        sink = partial(to_update_log, path=log, mode=mode)
        finish(start(stream(), sink=sink, **common), 120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = table(spark.read.parquet(f"{folder}/landing-*"))
    got = latest(spark.read.parquet(log), keys)
    whole = whole.join(got.select(*keys), keys, "left_semi")
    assert got.count() > 200
    columns = sorted(whole.columns)
    left, right = got.select(*columns), whole.select(*columns)
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_file_sink_takes_append_only(spark, tmp_path, mode):
    counted = word_count(text_lines(spark, lines_dir(tmp_path, "a\n")))
    with pytest.raises(AnalysisException, match="UNSUPPORTED_DATASOURCE"):
        to_json_files(counted, str(tmp_path / "out"), str(tmp_path / "ckpt"), mode=mode)


def test_append_needs_a_watermark(spark, tmp_path):
    counted = word_count(text_lines(spark, lines_dir(tmp_path, "a\n")))
    with pytest.raises(AnalysisException):
        to_update_log(counted, str(tmp_path / "out"), str(tmp_path / "ckpt"), mode="append")


def test_complete_needs_an_aggregation(spark, tmp_path):
    lines = text_lines(spark, lines_dir(tmp_path, "a\n"))
    with pytest.raises(AnalysisException):
        to_snapshots(lines, str(tmp_path / "out"), str(tmp_path / "ckpt"))


def test_mode_names_ignore_case(spark, tmp_path):
    lines = text_lines(spark, lines_dir(tmp_path, "a\n"))
    out = str(tmp_path / "out")
    finish(
        to_json_files(lines, out, str(tmp_path / "ckpt"), trigger=AVAILABLE_NOW, mode="Append"), 120
    )
    assert spark.read.json(out).count() == 1


def test_interval_and_default_trigger(spark, tmp_path):
    lines = text_lines(spark, lines_dir(tmp_path, "a\n", "b\n"))
    for number, trigger in enumerate([None, "1 second"]):
        out = str(tmp_path / f"out{number}")
        checkpoint = str(tmp_path / f"ckpt{number}")
        query = to_json_files(lines, out, checkpoint, f"copy {number}", trigger)
        assert query.name == f"copy {number}"
        query.processAllAvailable()
        assert query.isActive
        query.stop()
        assert spark.read.json(out).count() == 2


def test_finish_stops_a_query_that_runs_on(spark, tmp_path):
    lines = text_lines(spark, lines_dir(tmp_path, "a\n"))
    query = to_json_files(lines, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger="1 minute")
    with pytest.raises(TimeoutError):
        finish(query, 1)
    assert not query.isActive


def test_inferred_files_are_flattened_and_archived(spark, tmp_path):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    archive, checkpoint = str(tmp_path / "archive"), str(tmp_path / "ckpt")
    for number in range(3):
        land_json(source, number, [invoice(str(number), [1.0, 2.0])])

    def run(fields=None):
        finish(
            jobs.flatten_files(
                spark, source, out, checkpoint, archive, fields, 1, name=None, trigger=AVAILABLE_NOW
            ),
            120,
        )

    run()
    flat = spark.read.schema(ddl(FLAT_ITEM)).json(out)
    assert flat.count() == 6
    assert flat.where("ItemQty = 2 and City = 'b'").count() == 6
    assert names(archive) == ["in-0.json", "in-1.json"]
    assert names(source) == ["in-2.json"]

    land_json(source, 3, [invoice("3", [1.0, 2.0])])
    run()
    assert spark.read.schema(ddl(FLAT_ITEM)).json(out).count() == 8
    assert names(archive) == ["in-0.json", "in-1.json", "in-2.json"]
    assert names(source) == ["in-3.json"]


def test_inferred_and_declared_schema(spark, tmp_path):
    source = str(tmp_path / "source")
    land_json(source, 0, [invoice("1", [1.0])])
    before = spark.conf.get("spark.sql.streaming.schemaInference")
    inferred = json_dir(spark, source)
    assert spark.conf.get("spark.sql.streaming.schemaInference") == before
    assert inferred.columns == sorted(inferred.columns)
    assert dict(flatten_invoices(inferred).dtypes)["ItemQty"] == "bigint"
    declared = json_dir(spark, source, INVOICE)
    assert flatten_invoices(declared).dtypes == list(FLAT_ITEM.items())
    with pytest.raises(ValueError, match="outside"):
        json_dir(spark, source, INVOICE, archive_dir=os.path.join(source, "done"))


def invoice_files(spark, tmp_path):
    folder = str(tmp_path / "records")
    documents = [
        invoice("1", [1.3, 1.3], card="c"),
        invoice("2", [], card="d"),
        invoice("3", [2.0], card="c"),
        invoice("4", [5.0], card="e", kind="OTHER"),
    ]
    for number, document in enumerate(documents):
        land_records(spark, folder, number, [(document["InvoiceNumber"], json.dumps(document))])
    return replay(spark, folder)


def test_flatten_records_job(spark, tmp_path):
    out = str(tmp_path / "out")
    stream = invoice_files(spark, tmp_path)
    finish(jobs.flatten_records(stream, out, str(tmp_path / "ckpt"), None, AVAILABLE_NOW), 120)
    flat = spark.read.schema(ddl(FLAT_ITEM)).json(out)
    assert sorted(row.InvoiceNumber for row in flat.collect()) == ["1", "1", "3", "4"]


def test_notify_job(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = partial(to_record_files, path=out)
    stream = invoice_files(spark, tmp_path)
    finish(jobs.notify(stream, str(tmp_path / "ckpt"), sink, None, AVAILABLE_NOW), 120)
    got = spark.read.parquet(out).selectExpr("string(key) k", "string(value) v").collect()
    assert sorted(row.k for row in got) == ["1", "2", "3", "4"]
    assert {json.loads(row.v)["LoyaltyPoint"] for row in got} == {2.0}


def test_published_items_to_rewards(spark, tmp_path):
    items, log = str(tmp_path / "items"), str(tmp_path / "log")
    publish = partial(to_record_files, path=items)
    stream = invoice_files(spark, tmp_path)
    finish(
        jobs.publish_items(
            stream, str(tmp_path / "ckpt1"), publish, "json", name=None, trigger=AVAILABLE_NOW
        ),
        120,
    )
    published = spark.read.parquet(items)
    assert decode_json(published, PUBLISHED_ITEM).count() == 4
    assert stored_records(spark, items).columns[:3] == ["key", "value", "topic"]
    for encode in (False, True):
        target = partial(to_update_log, path=f"{log}-{encode}")
        finish(
            jobs.reward_cards(
                replay_records(spark, items, max_files=1),
                str(tmp_path / f"ckpt2-{encode}"),
                target,
                "json",
                encode=encode,
                name=None,
                trigger=AVAILABLE_NOW,
            ),
            120,
        )
    rewards = latest(spark.read.parquet(f"{log}-False"), ["CustomerCardNo"]).collect()
    assert [(r.CustomerCardNo, r.TotalPurchase, r.AggregatedRewards) for r in rewards] == [
        ("c", pytest.approx(4.6), 8)
    ]
    encoded = latest(spark.read.parquet(f"{log}-True"), ["key"]).collect()
    assert [row.key for row in encoded] == ["c"]
    assert json.loads(encoded[0].value)["AggregatedRewards"] == 8


@pytest.mark.parametrize("single_read", [False, True])
def test_split_invoices(spark, tmp_path, single_read):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = invoice_files(spark, tmp_path)
    queries = jobs.split_invoices(stream, out, checkpoint, single_read, AVAILABLE_NOW)
    assert len(queries) == (1 if single_read else 2)
    finish(queries, 120)
    items = spark.read.schema(ddl(FLAT_ITEM)).json(f"{out}/invoice")
    notes = spark.read.schema("key string, value string").json(f"{out}/notification")
    assert sorted(row.InvoiceNumber for row in items.collect()) == ["1", "1", "3", "4"]
    assert sorted(row.key for row in notes.collect()) == ["1", "2", "3", "4"]


def test_fan_out_stops_all_when_one_cannot_start(spark, tmp_path):
    lines = text_lines(spark, lines_dir(tmp_path, "a\n"))

    def broken(df):
        raise RuntimeError("no such branch")

    branches = {"good": lambda df: df, "bad": broken}
    with pytest.raises(RuntimeError, match="no such branch"):
        fan_out(lines, branches, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert [query for query in spark.streams.active if query.name == "good"] == []


def test_wait_for_any(spark, tmp_path):
    spark.streams.resetTerminated()
    lines = text_lines(spark, lines_dir(tmp_path, "a\n"))
    query = to_json_files(lines, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger="1 minute")
    assert wait_for_any(spark, 1) is False
    query.stop()
    assert wait_for_any(spark, 30) is True
    spark.streams.resetTerminated()


def test_trades_update_batches_and_side_metric(spark, tmp_path):
    folder = str(tmp_path / "trades")
    land_records(spark, folder, 0, [trade("10:05:00", "BUY", 500), (None, "broken")])
    land_records(spark, folder, 1, [trade("10:12:00", "SELL", 300)])
    land_records(spark, folder, 2, [trade("08:00:00", "BUY", 7)])
    log = str(tmp_path / "log")
    query = jobs.total_trades(
        replay(spark, folder),
        str(tmp_path / "ckpt"),
        partial(to_update_log, path=log),
        name=None,
        trigger=AVAILABLE_NOW,
    )
    finish(query, 120)
    rows = spark.read.parquet(log).collect()
    batches = {
        n: clock([row for row in rows if row.batch_id == n], "TotalBuy", "TotalSell")
        for n in range(3)
    }
    # Changed windows only, and without a watermark no row is ever late.
    assert batches == {
        0: [("10:00", "10:15", 500, 0)],
        1: [("10:00", "10:15", 500, 300)],
        2: [("08:00", "08:15", 7, 0)],
    }
    undated = [p.observedMetrics["undated_trades"]["rows"] for p in query.recentProgress]
    assert sum(undated) == 1


def test_trades_with_delay_are_bounded(spark, tmp_path):
    folder = str(tmp_path / "trades")
    for number, time in enumerate(["10:05:00", "12:00:00", "12:01:00", "08:00:00"]):
        land_records(spark, folder, number, [trade(time, "BUY", 1)])
    log = str(tmp_path / "log")
    query = jobs.total_trades(
        replay(spark, folder),
        str(tmp_path / "ckpt"),
        partial(to_update_log, path=log),
        delay="30 minutes",
        name=None,
        trigger=AVAILABLE_NOW,
    )
    finish(query, 120)
    starts = {f"{row.start:%H:%M}" for row in spark.read.parquet(log).collect()}
    assert starts == {"10:00", "12:00"}


def test_stream_in_ordered_batches_equals_table(spark, tmp_path):
    rows = [
        reading(f"{9 + i // 60:02d}:{i % 60:02d}:00", float(i * 7 % 31), sensor=f"s{i % 3}")
        for i in range(0, 240, 4)
    ]
    folder = str(tmp_path / "readings")
    for number in range(6):
        land_records(spark, folder, number, rows[number * 10 : number * 10 + 10])
    log = str(tmp_path / "log")
    sink = partial(to_update_log, path=log)
    finish(
        jobs.track_sensors(
            replay(spark, folder), str(tmp_path / "ckpt"), sink, name=None, trigger=AVAILABLE_NOW
        ),
        120,
    )
    keys = ["SensorID", "start", "end"]
    streamed = latest(spark.read.parquet(log), keys).select(*keys, "MaxReading")
    table = jobs.sensor_windows(records(spark, rows)).select(*keys, "MaxReading")
    assert sorted(streamed.collect()) == sorted(table.collect())
