"""Late rows, batch by batch. Day 2019-02-05, sensor A, 15/5-minute windows, 30 minutes delay."""

from __future__ import annotations

import os
from functools import partial

import pytest

from helpers import clock, land_records, reading, replay
from rillflow.plans.jobs import track_sensors
from rillflow.streaming.runner import finish
from rillflow.streaming.sinks import AVAILABLE_NOW, latest, to_update_log

FAR = [
    [("10:00:00", 1.0)],
    [("11:00:00", 2.0)],
    [("10:31:00", 8.0)],
    [("10:02:00", 9.0), ("10:20:00", 7.0)],
    [("10:58:00", 3.0)],
]
NEAR = [
    [("10:00:00", 1.0)],
    [("11:00:00", 2.0)],
    [("10:02:00", 9.0), ("10:20:00", 7.0), ("10:31:00", 8.0)],
]


def land(spark, folder, files, first=0):
    for number, rows in enumerate(files, start=first):
        land_records(spark, folder, number, [reading(*row) for row in rows])


def run(spark, folder, mode="update"):
    sink = partial(to_update_log, path=os.path.join(folder, "log"), mode=mode)
    query = track_sensors(
        replay(spark, folder), os.path.join(folder, "ckpt"), sink, name=None, trigger=AVAILABLE_NOW
    )
    finish(query, 120)
    return query


def batches(spark, folder):
    rows = spark.read.parquet(os.path.join(folder, "log")).collect()
    numbers = sorted({row.batch_id for row in rows})
    return {n: clock([r for r in rows if r.batch_id == n], "MaxReading") for n in numbers}


FIRST = [("09:50", "10:05", 1.0), ("09:55", "10:10", 1.0), ("10:00", "10:15", 1.0)]
SECOND = [("10:50", "11:05", 2.0), ("10:55", "11:10", 2.0), ("11:00", "11:15", 2.0)]


def test_update_mode_and_restart(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, FAR[:4])
    query = run(spark, folder)
    assert batches(spark, folder) == {
        0: FIRST,
        1: SECOND,
        2: [("10:20", "10:35", 8.0), ("10:25", "10:40", 8.0), ("10:30", "10:45", 8.0)],
        # Windows ending by 10:30 are closed; the 7.0 meets one that is open and does not raise it.
        3: [("10:20", "10:35", 8.0)],
    }
    dropped = sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )
    assert dropped > 0

    before = batches(spark, folder)
    run(spark, folder)
    assert batches(spark, folder) == before

    land(spark, folder, FAR[4:], first=4)
    run(spark, folder)
    after = batches(spark, folder)
    new = [row for n in after if n not in before for row in after[n]]
    assert sorted(new) == [
        ("10:45", "11:00", 3.0),
        ("10:50", "11:05", 3.0),
        ("10:55", "11:10", 3.0),
    ]


def test_append_mode(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, FAR)
    run(spark, folder, "append")
    assert batches(spark, folder) == {2: FIRST}


def test_late_rows_directly_after_the_jump_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, NEAR)
    run(spark, folder)
    assert batches(spark, folder)[2] == [
        ("09:50", "10:05", 9.0),
        ("09:55", "10:10", 9.0),
        ("10:00", "10:15", 9.0),
        ("10:10", "10:25", 7.0),
        ("10:15", "10:30", 7.0),
        ("10:20", "10:35", 8.0),
        ("10:25", "10:40", 8.0),
        ("10:30", "10:45", 8.0),
    ]
    log = spark.read.parquet(os.path.join(folder, "log"))
    newest = latest(log, ["SensorID", "start", "end"])
    assert newest.count() == 11
    assert newest.columns == ["SensorID", "start", "end", "MaxReading"]
    assert ("09:50", "10:05", 9.0) in clock(newest.collect(), "MaxReading")


def test_append_mode_directly_after_the_jump(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, NEAR)
    run(spark, folder, "append")
    assert batches(spark, folder)[2] == [
        ("09:50", "10:05", 9.0),
        ("09:55", "10:10", 9.0),
        ("10:00", "10:15", 9.0),
        ("10:10", "10:25", 7.0),
        ("10:15", "10:30", 7.0),
    ]


def test_late_rows_after_a_pause_are_dropped(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, NEAR[:2])
    run(spark, folder)
    land(spark, folder, NEAR[2:], first=2)
    run(spark, folder)
    assert batches(spark, folder)[3] == [
        ("10:20", "10:35", 8.0),
        ("10:25", "10:40", 8.0),
        ("10:30", "10:45", 8.0),
    ]


def test_single_watermark_setting_drops_at_once(spark, tmp_path):
    folder = str(tmp_path)
    setting = "spark.sql.streaming.statefulOperator.allowMultiple"
    land(spark, folder, NEAR)
    spark.conf.set(setting, "false")
    try:
        run(spark, folder)
    finally:
        spark.conf.unset(setting)
    assert batches(spark, folder)[2] == [
        ("10:20", "10:35", 8.0),
        ("10:25", "10:40", 8.0),
        ("10:30", "10:45", 8.0),
    ]


@pytest.mark.parametrize("delay, kept", [(None, 8), ("2 hours", 8), ("30 minutes", 3)])
def test_delay_decides_what_is_late(spark, tmp_path, delay, kept):
    folder = str(tmp_path)
    sink = partial(to_update_log, path=os.path.join(folder, "log"))

    def once():
        finish(
            track_sensors(
                replay(spark, folder),
                os.path.join(folder, "ckpt"),
                sink,
                delay=delay,
                name=None,
                trigger=AVAILABLE_NOW,
            ),
            120,
        )

    land(spark, folder, NEAR[:2])
    once()
    before = set(batches(spark, folder))
    land(spark, folder, NEAR[2:], first=2)
    once()
    after = batches(spark, folder)
    assert sum(len(after[n]) for n in after if n not in before) == kept
