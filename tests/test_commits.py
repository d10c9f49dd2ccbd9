"""Commits by manifest: update logs with a base, fan-outs in whole batches, after crashes too."""

from __future__ import annotations

import os
from functools import partial

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import land_records, replay, trade
from rillflow.plans import jobs
from rillflow.streaming import fanout, manifests, sinks
from rillflow.streaming.fanout import fan_out_single_read, read_branch
from rillflow.streaming.runner import finish
from rillflow.streaming.sinks import AVAILABLE_NOW, compact, latest, read_update_log, to_update_log

FIELDS = {"key": "string", "n": "bigint"}


def batch(spark, path, number, rows):
    frame = spark.createDataFrame(rows, "key string, n long")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def state(spark, path, upto=None):
    rows = latest(read_update_log(spark, path, upto), ["key"]).collect()
    return {row.key: row.n for row in rows}


def folders(path):
    return sorted(name for name in os.listdir(path) if not name.startswith("."))


def test_manifests_replace_each_other(spark, tmp_path):
    folder = str(tmp_path / "m")
    assert manifests.newest(spark, folder) is None and manifests.numbers(spark, folder) == []
    for number in (1, 2, 10, 11):
        manifests.commit(spark, folder, number, {"upto": number, "name": "é"})
    manifests.commit(spark, folder, 11, {"upto": 11, "name": "é"})
    assert manifests.numbers(spark, folder) == [10, 11]
    assert manifests.newest(spark, folder) == {"upto": 11, "name": "é"}
    (tmp_path / "m" / ".12.draft").write_text("half")
    assert manifests.newest(spark, folder)["upto"] == 11


def test_rows_read_stay_bounded(spark, tmp_path):
    path = str(tmp_path / "log")
    expected = {}
    for number in range(50):
        rows = [(f"k{(number + i) % 7}", number * 10 + i) for i in range(3)]
        expected |= dict(rows)
        batch(spark, path, number, rows)
        if (number + 1) % 5 == 0:
            compact(spark, path, ["key"], number)
        log = read_update_log(spark, path)
        # A base of seven keys and at most four open batches of three rows.
        assert log.count() <= 7 + 4 * 3
        assert state(spark, path) == expected
    # Files of the last two bases only, and the batches since the one before the last.
    assert folders(path) == ["_bases", *(f"batch_id={n}" for n in range(45, 50))]
    assert folders(f"{path}/_bases") == ["44.json", "49.json", "upto=44", "upto=49"]


def test_a_base_without_manifest_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for number in range(4):
        batch(spark, path, number, [("a", number), (f"b{number}", number)])
    before = state(spark, path)

    def lost(*args, **kwargs):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(sinks.manifests, "commit", lost)
    with pytest.raises(RuntimeError):
        compact(spark, path, ["key"], 3)
    assert os.path.isdir(f"{path}/_bases/upto=3")
    assert state(spark, path) == before and read_update_log(spark, path).count() == 8
    monkeypatch.undo()
    compact(spark, path, ["key"], 3)
    assert state(spark, path) == before and read_update_log(spark, path).count() == 5
    # A batch that is repeated after its base changes nothing.
    batch(spark, path, 3, [("a", 3), ("b3", 3)])
    compact(spark, path, ["key"], 3)
    assert read_update_log(spark, path).count() == 5 and state(spark, path) == before


def test_readers_of_the_old_base_can_go_on(spark, tmp_path):
    path = str(tmp_path / "log")
    for number in range(2):
        batch(spark, path, number, [("a", number)])
    compact(spark, path, ["key"], 1)
    batch(spark, path, 2, [("b", 2)])
    reader = read_update_log(spark, path)
    batch(spark, path, 3, [("a", 3)])
    compact(spark, path, ["key"], 3)
    assert {row.key: row.n for row in reader.collect()} == {"a": 1, "b": 2}
    assert state(spark, path) == {"a": 3, "b": 2}


def test_compacted_stream_equals_the_whole_log(spark, tmp_path):
    folder = str(tmp_path / "in")
    times = ["10:05", "10:20", "10:05", "10:35", "10:20", "10:07", "11:00"]
    for number, time in enumerate(times):
        land_records(spark, folder, number, [trade(f"{time}:00", "BUY", 10 + number)])
    results = []
    for name, options in (("whole", {}), ("merged", {"keys": ["start", "end"], "compact_every": 3})):
        out = str(tmp_path / name)
        sink = partial(to_update_log, path=out, **options)
        finish(jobs.total_trades(replay(spark, folder), f"{out}-ckpt", sink, trigger=AVAILABLE_NOW), 200)
        rows = latest(read_update_log(spark, out), ["start", "end"])
        results.append(sorted(map(str, rows.select("start", "TotalBuy").collect())))
    assert results[0] == results[1] and len(results[0]) == 4
    assert folders(tmp_path / "merged") == ["_bases", "batch_id=3", "batch_id=4", "batch_id=5", "batch_id=6"]


def test_keys_and_interval_go_together(spark, tmp_path):
    with pytest.raises(ValueError):
        to_update_log(spark.range(1), "x", "y", keys=["id"])
    with pytest.raises(FileNotFoundError):
        read_update_log(spark, str(tmp_path / "none"))


def arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    for number in range(3):
        land_records(spark, folder, number, [(f"k{number}", "v"), (f"x{number}", "w")])
    return folder


def branches(fail_at=None):
    def second(rows):
        def check(value):
            if value == fail_at:
                raise RuntimeError("lost in the second branch")
            return value

        return rows.select(F.udf(check, "string")("key").alias("key"), F.lit(2).alias("n"))

    return {"one": lambda rows: rows.select("key", F.lit(1).alias("n")), "two": second}


def keys(spark, out, branch):
    return sorted(row.key for row in read_branch(spark, out, branch, FIELDS).collect())


def test_a_batch_is_in_all_branches_or_in_none(spark, tmp_path):
    folder, out, checkpoint = arrivals(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = replay(spark, folder).select(F.col("key").cast("string").alias("key"))
    assert keys(spark, out, "one") == []
    with pytest.raises(StreamingQueryException):
        finish(fan_out_single_read(stream, branches("k1"), out, checkpoint, trigger=AVAILABLE_NOW), 100)
    # The first branch has the files of the second batch, and no reader takes them.
    assert os.path.isdir(f"{out}/one/batch_id=1")
    assert keys(spark, out, "one") == keys(spark, out, "two") == ["k0", "x0"]
    finish(fan_out_single_read(stream, branches(), out, checkpoint, trigger=AVAILABLE_NOW), 100)
    whole = ["k0", "k1", "k2", "x0", "x1", "x2"]
    assert keys(spark, out, "one") == keys(spark, out, "two") == whole
    with pytest.raises(ValueError):
        read_branch(spark, out, "three", FIELDS)


def test_a_committed_batch_is_not_written_again(spark, tmp_path, monkeypatch):
    """Lost between the manifest and Spark's own commit: the batch comes again and is left alone."""
    folder, out, checkpoint = arrivals(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = replay(spark, folder).select(F.col("key").cast("string").alias("key"))
    commit = manifests.commit

    def lost_after(spark, folder, number, content, **options):
        commit(spark, folder, number, content, **options)
        if number == 1:
            raise RuntimeError("lost after the manifest")

    monkeypatch.setattr(fanout.manifests, "commit", lost_after)
    with pytest.raises(StreamingQueryException):
        finish(fan_out_single_read(stream, branches(), out, checkpoint, trigger=AVAILABLE_NOW), 100)
    monkeypatch.undo()
    written = {name: os.stat(f"{out}/one/batch_id=1/{name}").st_mtime_ns
               for name in os.listdir(f"{out}/one/batch_id=1")}
    finish(fan_out_single_read(stream, branches(), out, checkpoint, trigger=AVAILABLE_NOW), 100)
    assert written == {name: os.stat(f"{out}/one/batch_id=1/{name}").st_mtime_ns
                       for name in os.listdir(f"{out}/one/batch_id=1")}
    assert keys(spark, out, "two") == ["k0", "k1", "k2", "x0", "x1", "x2"]
