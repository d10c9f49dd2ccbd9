"""The jobs as started from the command line, on replayed files."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest

from helpers import clock, invoice, land_json, records, reading, trade
from rillflow.__main__ import JOBS, parser, start
from rillflow.functions.codecs import ConnectorMissing
from rillflow.schemas import FLAT_ITEM, RECORD, ddl
from rillflow.session import SCALE_CONF, build_session, scratch_dir
from rillflow.streaming.runner import finish
from rillflow.streaming.sinks import latest, read_snapshot


@pytest.fixture
def run(spark, tmp_path):
    def once(job, *arguments):
        common = ["--checkpoint", str(tmp_path / f"ckpt-{job}"), "--trigger", "available now"]
        finish(start(spark, parser().parse_args([job, *common, *map(str, arguments)])), 120)

    return once


@pytest.fixture
def stored(spark, tmp_path):
    def write(pairs):
        path = str(tmp_path / "records")
        records(spark, pairs).selectExpr(
            "key",
            "value",
            *(f"cast(null as {kind}) as {name}" for name, kind in list(RECORD.items())[2:]),
        ).write.parquet(path)
        return path

    return write


INVOICES = [
    (number, json.dumps(invoice(number, items, card=card)))
    for number, items, card in [("1", [1.3, 1.3], "c"), ("2", [], "d"), ("3", [2.0], "c")]
]


def test_count_words(spark, tmp_path, run):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text("a b a\n")
    run("count-words", "--input", tmp_path / "text", "--output", tmp_path / "out")
    rows = read_snapshot(spark, str(tmp_path / "out")).collect()
    assert {row.value: row["count"] for row in rows} == {"a": 2, "b": 1}


def test_flatten_files(spark, tmp_path, run):
    land_json(str(tmp_path / "in"), 0, [invoice("1", [1.0, 2.0])])
    land_json(str(tmp_path / "in"), 1, [invoice("2", [1.0])])
    folders = "--input", tmp_path / "in", "--output", tmp_path / "out", "--archive", tmp_path / "a"
    run("flatten-files", *folders, "--option", "maxFilesPerTrigger=1")
    assert [path.name for path in (tmp_path / "a").rglob("*.json")] == ["in-0.json"]
    assert spark.read.schema(ddl(FLAT_ITEM)).json(str(tmp_path / "out")).count() == 3


def test_flatten_records(spark, tmp_path, run, stored):
    run("flatten-records", "--records", stored(INVOICES), "--output", tmp_path / "out")
    assert spark.read.schema(ddl(FLAT_ITEM)).json(str(tmp_path / "out")).count() == 3


def test_notify(spark, tmp_path, run, stored):
    run("notify", "--records", stored(INVOICES), "--output", tmp_path / "out")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_publish_then_reward(spark, tmp_path, run, stored):
    items, log = tmp_path / "items", tmp_path / "log"
    run("publish-items", "--codec", "json", "--records", stored(INVOICES), "--output", items)
    run("reward-cards", "--codec", "json", "--records", items, "--output", log)
    rows = latest(spark.read.parquet(str(log)), ["key"]).collect()
    assert {row.key: json.loads(row.value)["AggregatedRewards"] for row in rows} == {"c": 8}


@pytest.mark.parametrize("single", [[], ["--single-read"]])
def test_split_invoices(spark, tmp_path, run, stored, single):
    arguments = "--output", tmp_path / "out", "--compression", "gzip", *single
    run("split-invoices", "--records", stored(INVOICES), *arguments)
    files = [path.name for path in (tmp_path / "out").rglob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)
    assert spark.read.schema(ddl(FLAT_ITEM)).json(str(tmp_path / "out" / "invoice")).count() == 3


def test_total_trades(spark, tmp_path, run, stored):
    path = stored([trade("10:05:00", "BUY", 5), trade("10:20:00", "SELL", 7)])
    run("total-trades", "--records", path, "--output", tmp_path / "log", "--width", "1 hour")
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert clock(rows, "TotalBuy", "TotalSell") == [("10:00", "11:00", 5, 7)]


def test_track_sensors(spark, tmp_path, run, stored):
    path = stored([reading("10:01:00", 1.0), reading("10:02:00", 3.0)])
    run("track-sensors", "--records", path, "--output", tmp_path / "log", "--slide", "15 minutes")
    rows = latest(spark.read.parquet(str(tmp_path / "log")), ["SensorID", "start", "end"]).collect()
    assert clock(rows, "MaxReading") == [("10:00", "10:15", 3.0)]


def test_track_sensors_on_rocksdb(spark, tmp_path, run, stored):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SCALE_CONF[key])
    try:
        path = stored([reading("10:01:00", 1.0), reading("10:02:00", 3.0)])
        run("track-sensors", "--records", path, "--output", tmp_path / "log")
    finally:
        spark.conf.unset(key)
    rows = latest(spark.read.parquet(str(tmp_path / "log")), ["SensorID", "start", "end"])
    assert rows.count() == 3


def test_topics_need_the_connector(spark, tmp_path, run):
    for job, (topic, _, _) in JOBS.items():
        if topic is not None:
            with pytest.raises(ConnectorMissing):
                run(job, "--output", tmp_path / "out")


def test_folders_are_asked_for(tmp_path, run):
    for job in ("flatten-files", "flatten-records", "split-invoices"):
        with pytest.raises(SystemExit, match="--output"):
            run(job)


def _session(**settings):
    """As much of a session as choosing a folder takes: the setting is fixed in a real one."""
    names = {name.replace("_", "."): value for name, value in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=names.get))


def test_scratch_folder_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    app = spark.conf.get("spark.app.id")
    assert scratch_dir(spark, "x").startswith(f"{shared}/rillflow-{app}/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    on_store = _session(spark_checkpoint_dir="hdfs://name/tmp/", spark_app_id="a1")
    assert scratch_dir(on_store, "x").startswith("hdfs://name/tmp/rillflow-a1/x-")


def test_built_session_keeps_what_is_set(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    built = build_session("again", {"spark.sql.adaptive.skewJoin.enabled": "false"})
    try:
        assert built.conf.get("spark.sql.session.timeZone") == "UTC"
        assert built.conf.get("spark.sql.shuffle.partitions") == before
        for key, value in SCALE_CONF.items():
            expected = "false" if key == "spark.sql.adaptive.skewJoin.enabled" else value
            assert built.conf.get(key) == expected
    finally:
        for key in SCALE_CONF:
            if key != "spark.sql.session.timeZone":
                spark.conf.unset(key)


def test_scratch_falls_back_to_the_warehouse():
    names = {"spark.sql.warehouse.dir": "s3a://store/house", "spark.app.id": "a1"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: names.get(key)))
    assert scratch_dir(session, "x").startswith("s3a://store/house/rillflow-a1/x-")


def test_scratch_of_a_session_can_be_cleared(spark, tmp_path, monkeypatch):
    from rillflow import session

    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path / "scratch"))
    path = scratch_dir(spark, "x")
    spark.range(1).write.parquet(path)
    session.clear_scratch(spark)
    assert not (tmp_path / "scratch").exists()


def test_waiting_has_no_limit_of_its_own():
    import inspect

    assert inspect.signature(finish).parameters["timeout"].default is None


def test_flattened_files_with_declared_fields(spark, tmp_path, run):
    land_json(str(tmp_path / "in"), 0, [invoice("1", [1.0, 2.0])])
    run(
        "flatten-files", "--input", tmp_path / "in", "--output", tmp_path / "out",
        "--schema", "invoice", "--name", "declared",
    )
    assert spark.read.json(str(tmp_path / "out")).count() == 2
