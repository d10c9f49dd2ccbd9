"""State read back, batch reports, kept schemas, quarantine, repeated deliveries, running queries."""

from __future__ import annotations

import glob
import json
import os
from functools import partial

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from helpers import land_json, land_records, reading, records, replay, trade
from rillflow.functions.codecs import decode_json, decoded_rows, quarantined_rows
from rillflow.operators.delivery import delivered_once
from rillflow.plans import jobs
from rillflow.plans.queries import SLOTS, q_rewards_delivered_once
from rillflow.schemas import PUBLISHED_LINE, RECORD
from rillflow.session import scratch_root, settings
from rillflow.sources.files import json_dir, replay_records
from rillflow.sources.inference import files_read, kept_schema, new_files, widened
from rillflow.sources.state import scaled_state, state_operators, state_rows
from rillflow.streaming import manifests
from rillflow.streaming.fanout import read_branch
from rillflow.streaming.progress import progress_table, recorded
from rillflow.streaming.runner import catch_up, finish, running
from rillflow.streaming.sinks import AVAILABLE_NOW, latest, to_json_files, to_update_log

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def sensors(spark, tmp_path, folder, **options):
    sink = partial(to_update_log, path=str(tmp_path / "log"))
    stream = replay(spark, folder)
    return jobs.track_sensors(stream, str(tmp_path / "ckpt"), sink, trigger=AVAILABLE_NOW, **options)


def test_closed_windows_have_left_the_state(spark, tmp_path):
    folder, before = str(tmp_path / "in"), spark.conf.get(PROVIDER, None)
    land_records(spark, folder, 0, [reading("10:02:00", 5.0), reading("10:03:00", 7.0, "B")])
    with scaled_state(spark):
        finish(sensors(spark, tmp_path, folder), 100)
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == before
    rows = state_rows(spark, str(tmp_path / "ckpt")).select("key.*", "value.*").collect()
    assert len(rows) == 6 and {row.max for row in rows} == {5.0, 7.0}
    land_records(spark, folder, 1, [reading("11:30:00", 1.0)])
    with scaled_state(spark):
        finish(sensors(spark, tmp_path, folder), 100)
    left = state_rows(spark, str(tmp_path / "ckpt")).select("key.window.end").collect()
    assert sorted(f"{row.end:%H:%M}" for row in left) == ["11:35", "11:40", "11:45"]
    # As it was after the first batch.
    assert state_rows(spark, str(tmp_path / "ckpt"), batch_id=0).count() == 6
    operators = state_operators(spark, str(tmp_path / "ckpt")).collect()
    assert [row.operatorName for row in operators] == ["stateStoreSave"]


def test_reports_of_every_batch_are_kept(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "progress")
    land_records(spark, folder, 0, [reading("12:00:00", 1.0), (None, "not json")])
    land_records(spark, folder, 1, [reading("12:01:00", 1.0)])
    with recorded(spark, path, {"watched"}):
        finish(sensors(spark, tmp_path, folder, name="watched"), 100)
        # Others are not recorded.
        rate = spark.readStream.format("rate").load().writeStream.format("noop").queryName("other").start()
        with running(rate):
            pass
    # Late for all three of its windows, twice for each of them.
    land_records(spark, folder, 2, [reading("10:00:00", 9.0), reading("10:01:00", 9.0)])
    with recorded(spark, path, {"watched"}):
        finish(sensors(spark, tmp_path, folder, name="watched"), 100)
    rows = progress_table(spark, path).orderBy("batch").collect()
    fed = [row for row in rows if row.rows_in]
    assert [row.rows_in for row in fed] == [2, 1, 2]
    assert [row.dropped for row in fed] == [0, 0, 3]
    assert [row.state_rows for row in fed] == [3, 3, 3]
    assert fed[0].observed["undated_readings"] == {"rows": 1}
    assert f"{fed[2].watermark:%H:%M}" == "11:31"
    assert len({row.run for row in rows}) == 2 and len({row.batch for row in rows}) == len(rows)


def test_a_report_that_cannot_be_written_is_told(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    land_records(spark, folder, 0, [reading("12:00:00", 1.0)])

    def lost(*args, **kwargs):
        raise OSError("no room")

    monkeypatch.setattr(manifests, "commit", lost)
    with pytest.raises(OSError, match="no room"):
        with recorded(spark, str(tmp_path / "progress")):
            finish(sensors(spark, tmp_path, folder), 100)


def kinds(text):
    return StructType.fromDDL(text)


def test_widened_types():
    one = kinds("a bigint, s struct<x: bigint, y: string>, l array<struct<q: bigint>>, t bigint")
    other = kinds("b string, s struct<z: double, x: double>, l array<struct<r: bigint>>, t string")
    assert widened(one, other) == kinds(
        "a bigint, s struct<x: double, y: string, z: double>, l array<struct<q: bigint, r: bigint>>, "
        "t string, b string"
    )
    assert widened(LongType(), LongType()) == LongType()
    assert widened(DoubleType(), LongType()) == DoubleType()
    assert widened(ArrayType(LongType()), LongType()) == StringType()
    assert widened(one, one) == one


def test_schema_grows_by_new_files_only(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    kept, checkpoint = str(tmp_path / "schema"), str(tmp_path / "ckpt")
    with pytest.raises(FileNotFoundError):
        os.makedirs(folder)
        kept_schema(spark, folder, kept, checkpoint)
    looked_at, schemas = [], []
    arrivals = [
        [{"a": 1, "s": {"x": 1}}], [{"a": 2, "s": {"x": 2}}],
        [{"a": 3.5, "s": {"x": 3, "y": "new"}, "b": [1]}], [{"s": None}],
    ]
    for number, documents in enumerate(arrivals):
        land_json(folder, number, documents)
        looked_at.append([path.rpartition("/")[2] for path in new_files(spark, folder, checkpoint)])
        schema = kept_schema(spark, folder, kept, checkpoint)
        schemas.append(schema.simpleString())
        finish(to_json_files(json_dir(spark, folder, schema), out, checkpoint, trigger=AVAILABLE_NOW), 100)
    assert looked_at == [[f"in-{n}.json"] for n in range(4)]
    first, wide = "struct<a:bigint,s:struct<x:bigint>>", (
        "struct<a:double,s:struct<x:bigint,y:string>,b:array<bigint>>"
    )
    assert schemas == [first, first, wide, wide]
    assert len(manifests.numbers(spark, kept)) == 2
    assert files_read(spark, checkpoint).count() == 4
    rows = spark.read.schema("a double, s struct<x: bigint, y: string>, b array<bigint>").json(out)
    assert sorted(json.dumps(row.asDict(True)) for row in rows.collect()) == sorted(
        json.dumps(row) for row in [
            {"a": 1.0, "s": {"x": 1, "y": None}, "b": None},
            {"a": 2.0, "s": {"x": 2, "y": None}, "b": None},
            {"a": 3.5, "s": {"x": 3, "y": "new"}, "b": [1]},
            {"a": None, "s": None, "b": None},
        ]
    )
    # Nothing new: nothing is looked at.
    assert new_files(spark, folder, checkpoint) == []
    assert kept_schema(spark, folder, kept, checkpoint).simpleString() == wide


def test_quarantine_parts_good_from_bad(spark):
    values = ['{"a": 1}', "no json", '{"a": "x"}', None, '{"a": 2, "z": 3}', "[1]", "\x00é"]
    rows = records(spark, [(str(n), value) for n, value in enumerate(values)])
    rows = decode_json(rows, {"a": "int"}, key_as="n", metric="both", quarantine="undecoded")
    good = decoded_rows(rows, "undecoded")
    assert good.columns == ["n", "a"]
    assert sorted(map(tuple, good.collect())) == [("0", 1), ("4", 2)]
    bad = quarantined_rows(rows, "undecoded", ["n"]).collect()
    assert {row.n: row.raw for row in bad} == {
        n: None if values[int(n)] is None else values[int(n)].encode() for n in "12356"
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    with pytest.raises(ValueError):
        decode_json(rows, {"a": "int"}, quarantine="undecoded")


def test_quarantine_of_a_stream(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "ckpt"))
    land_records(spark, folder, 0, [("a", '{"k": 1}'), ("b", "퟿ bad")])
    land_records(spark, folder, 1, [("c", None), ("d", '{"k": 2}')])
    finish(jobs.decode_or_quarantine(
        replay(spark, folder), {"k": "int"}, out, checkpoint, trigger=AVAILABLE_NOW), 100)
    good = read_branch(spark, out, "decoded", {**jobs.ORIGIN, "k": "int"})
    assert sorted(row.k for row in good.collect()) == [1, 2]
    bad = read_branch(spark, out, "quarantine", {**jobs.ORIGIN, "raw": "binary"})
    found = [row.raw for row in bad.collect()]
    assert len(found) == 2 and None in found and bytearray("퟿ bad".encode()) in found


def item(line, value, time, card="c", kind="PRIME"):
    fields = {"CustomerType": kind, "CustomerCardNo": card, "TotalValue": value, "CreatedTime": time}
    return "i", json.dumps({**fields, "LineId": line})


def test_repeated_deliveries_count_once(spark, tmp_path):
    folder, hour = str(tmp_path / "in"), 3_600_000
    land_records(spark, folder, 0, [item("r-0", 5.0, hour), item("r-1", 5.0, hour), item("r-0", 5.0, hour)])
    land_records(spark, folder, 1, [item("r-1", 5.0, hour), item("s-0", 1.0, 2 * hour), item(None, 7.0, hour)])
    land_records(spark, folder, 2, [item(None, 7.0, 2 * hour), item("s-0", 1.0, 2 * hour), item("t", 9.0, hour, kind="X")])

    def total(**options):
        out = str(tmp_path / f"log-{len(options)}")
        sink = partial(to_update_log, path=out)
        stream = replay(spark, folder)
        finish(jobs.reward_cards(stream, f"{out}-ckpt", sink, "json", encode=False, trigger=AVAILABLE_NOW, **options), 200)
        return latest(spark.read.parquet(out), ["CustomerCardNo"]).first().TotalPurchase

    assert total() == 5 * 4 + 1 * 2 + 7 * 2
    assert total(once_within="2 hours") == 5 * 2 + 1 + 7 * 2


def test_line_ids_tell_equal_items_apart(spark):
    line = {"ItemCode": "1", "ItemDescription": "x", "ItemPrice": 1.0, "ItemQty": 1, "TotalValue": 2.0}
    invoice = json.dumps({"InvoiceNumber": "n", "CreatedTime": 5, "InvoiceLineItems": [line, line]})
    sent = records(spark, [("n", invoice), ("n", invoice)])
    published = jobs.item_records(sent, "json", line_ids=True)
    items = decode_json(published, PUBLISHED_LINE)
    assert items.count() == 4 and items.select("LineId").distinct().count() == 2
    assert delivered_once(items, "1 hour").count() == 2
    assert "LineId" not in jobs.item_records(sent, "json").first().value


def test_running_queries_catch_up_and_stop(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "log")
    sink = partial(to_update_log, path=out)
    empty = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in RECORD.items()))
    empty.write.parquet(f"{folder}/landing-none")
    for name in os.listdir(f"{folder}/landing-none"):
        # Files much older than the newest one are not picked up.
        os.utime(f"{folder}/landing-none/{name}", (1_600_000_000,) * 2)
    stream = replay_records(spark, f"{folder}/landing-*")
    query = jobs.total_trades(stream, f"{out}-ckpt", sink, trigger=None)
    with running(query):
        for number in range(2):
            land_records(spark, folder, number, [trade("10:05:00", "BUY", 10)])
            catch_up(query)
            rows = latest(spark.read.parquet(out), ["start", "end"]).collect()
            assert [row.TotalBuy for row in rows] == [10 * (number + 1)]
        assert query.isActive
    assert not query.isActive
    fail = F.udf(lambda value: 1 // 0, "int")
    failing = replay(spark, folder).select(fail("value").alias("x"))
    query = failing.writeStream.format("noop").option("checkpointLocation", f"{out}-fail").start()
    with pytest.raises(StreamingQueryException):
        with running(query):
            catch_up(query)




def test_rewards_commit_their_state_once_an_arrival(spark):
    """No batch without rows, and no more state partitions than four for each core."""
    with settings(spark, {"spark.sql.shuffle.partitions": "40"}):
        q_rewards_delivered_once(spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    work = max(glob.glob(f"{scratch_root(spark)}/rewards_delivered_once-*"), key=os.path.getmtime)
    assert sum(name.isdigit() for name in os.listdir(f"{work}/reward/commits")) == SLOTS
    partitions = sum(name.isdigit() for name in os.listdir(f"{work}/reward/state/0"))
    assert partitions <= 4 * spark.sparkContext.defaultParallelism < 40
