"""Run one of the jobs: ``python -m rillflow JOB --checkpoint DIR ...``."""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillflow.plans import jobs
from rillflow.schemas import INVOICE
from rillflow.session import build_session
from rillflow.sources.files import replay_records, text_lines
from rillflow.sources.kafka import kafka_records
from rillflow.sources.sockets import socket_lines
from rillflow.streaming.runner import finish, wait_for_any
from rillflow.streaming.sinks import AVAILABLE_NOW, to_record_files, to_snapshots, to_update_log

# Job: the topic it reads, the topic it writes, its trigger.
JOBS = {
    "count-words": (None, None, None),
    "flatten-files": (None, None, jobs.MINUTE),
    "flatten-records": (jobs.INVOICES_TOPIC, None, jobs.MINUTE),
    "notify": (jobs.INVOICES_TOPIC, jobs.NOTIFICATION_TOPIC, jobs.MINUTE),
    "publish-items": (jobs.INVOICES_TOPIC, jobs.PUBLISHED_TOPIC, None),
    "reward-cards": (jobs.PUBLISHED_TOPIC, jobs.REWARDS_TOPIC, None),
    "split-invoices": (jobs.INVOICES_TOPIC, None, jobs.SECOND),
    "total-trades": (jobs.TRADES_TOPIC, None, jobs.MINUTE),
    "track-sensors": (jobs.SENSOR_TOPIC, None, jobs.MINUTE),
}


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="rillflow", description=__doc__)
    args.add_argument("job", choices=list(JOBS))
    args.add_argument("--checkpoint", required=True, help="folder for the query's progress")
    args.add_argument("--servers", default="localhost:9092", help="Kafka bootstrap servers")
    args.add_argument("--topic", help="topic to read, instead of the job's own")
    args.add_argument("--to-topic", help="topic to write, instead of the job's own")
    args.add_argument("--starting", default="earliest", help="where a new query starts in a topic")
    args.add_argument("--records", help="folder of record files to read instead of a topic")
    args.add_argument("--input", help="folder of text or JSON files to read")
    args.add_argument("--host", default="localhost", help="peer that sends lines")
    args.add_argument("--port", type=int, default=9999)
    args.add_argument("--output", help="folder to write instead of a topic or the console")
    args.add_argument("--archive", help="folder that receives the files that have been read")
    args.add_argument("--compression", help="codec of the JSON files written, as gzip")
    args.add_argument("--trigger", help=f"interval, or '{AVAILABLE_NOW}'")
    args.add_argument("--codec", choices=["avro", "json"], default="avro")
    args.add_argument("--width", default="15 minutes", help="window length")
    args.add_argument("--slide", default="5 minutes", help="step between sliding windows")
    args.add_argument("--delay", help="how late an event may be; 'none' for ever")
    args.add_argument("--single-read", action="store_true", help="split in one query")
    args.add_argument("--name", help="name of the query, instead of the job's own")
    args.add_argument("--segment", default="PRIME", help="customers that are rewarded")
    args.add_argument("--rows", type=int, default=20, help="rows the console shows of a batch")
    args.add_argument("--schema", choices=["inferred", "invoice"], default="inferred",
                      help="fields of the files to flatten; inferred reads all of them once more")
    pairs = {"action": "append", "default": [], "metavar": "KEY=VALUE"}
    args.add_argument("--option", help="source option, as maxOffsetsPerTrigger=100000", **pairs)
    args.add_argument("--conf", help="session setting", **pairs)
    return args


def _settings(pairs: list[str]) -> dict[str, str]:
    return dict(pair.split("=", 1) for pair in pairs)


def _records(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    options = _settings(args.option)
    if args.records:
        return replay_records(spark, args.records, **options)
    topic = args.topic or JOBS[args.job][0]
    return kafka_records(spark, args.servers, topic, args.starting, **options)


def _record_sink(args: argparse.Namespace, mode: str) -> jobs.Sink:
    if args.output and mode == "append":
        return partial(to_record_files, path=args.output)
    if args.output:
        return partial(to_update_log, path=args.output)
    return jobs.kafka_sink(args.servers, args.to_topic or JOBS[args.job][1], mode)


def _table_sink(args: argparse.Namespace) -> jobs.Sink:
    if args.output:
        return partial(to_update_log, path=args.output)
    return jobs.console_sink("update", args.rows)


def start(spark: SparkSession, args: argparse.Namespace) -> list[StreamingQuery]:
    """Start the job's query or queries."""
    common = {"checkpoint": args.checkpoint, "trigger": args.trigger or JOBS[args.job][2]}
    if args.name and args.job != "split-invoices":
        common["name"] = args.name
    codec = {"compression": args.compression}
    delay = None if args.delay == "none" else args.delay
    if args.job in ("flatten-files", "flatten-records", "split-invoices") and not args.output:
        raise SystemExit(f"{args.job} needs --output")
    if args.job == "count-words":
        if args.input:
            lines = text_lines(spark, args.input, **_settings(args.option))
        else:
            lines = socket_lines(spark, args.host, args.port)
        console = jobs.console_sink("complete", args.rows)
        sink = partial(to_snapshots, path=args.output) if args.output else console
        return [jobs.count_words(lines, sink=sink, **common)]
    if args.job == "flatten-files":
        if not args.input:
            raise SystemExit("flatten-files needs --input")
        paths = {"path": args.input, "output": args.output, "archive_dir": args.archive}
        options = _settings(args.option)
        fields = INVOICE if args.schema == "invoice" else None
        files = jobs.flatten_files(
            spark, **paths, fields=fields, options=options, **codec, **common
        )
        return [files]
    records = _records(spark, args)
    if args.job == "flatten-records":
        return [jobs.flatten_records(records, args.output, **codec, **common)]
    if args.job == "notify":
        return [jobs.notify(records, sink=_record_sink(args, "append"), **common)]
    if args.job == "publish-items":
        sink = _record_sink(args, "append")
        return [jobs.publish_items(records, sink=sink, codec=args.codec, **common)]
    if args.job == "reward-cards":
        sink = _record_sink(args, "update")
        chosen = {"codec": args.codec, "segment": args.segment}
        return [jobs.reward_cards(records, sink=sink, **chosen, **common)]
    if args.job == "split-invoices":
        single = args.single_read
        return jobs.split_invoices(records, args.output, single_read=single, **codec, **common)
    if args.job == "total-trades":
        sink = _table_sink(args)
        return [jobs.total_trades(records, sink=sink, width=args.width, delay=delay, **common)]
    late = {} if args.delay is None else {"delay": delay}
    sink = _table_sink(args)
    windows = {"width": args.width, "slide": args.slide}
    return [jobs.track_sensors(records, sink=sink, **windows, **late, **common)]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"rillflow {args.job}", _settings(args.conf))
    queries = start(spark, args)
    if args.trigger == AVAILABLE_NOW:
        finish(queries)
    else:
        wait_for_any(spark)


if __name__ == "__main__":
    main()
