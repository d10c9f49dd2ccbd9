"""The registered queries, each over whole tables, and the SQL that checks them.

The first group runs the transforms on tables, the second runs the jobs as streams to the end of
their input and reads back what they wrote. Both take their records through the JSON wire format.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillflow.functions.codecs import decode_json, encode_json
from rillflow.operators.aggregates import word_count
from rillflow.plans import jobs, tables
from rillflow.schemas import (
    FLAT_ITEM,
    INVOICE,
    NOTIFICATION,
    PUBLISHED_ITEM,
    REWARD,
    TIME_FORMAT,
    ddl,
)
from rillflow.session import scratch_dir, settings
from rillflow.sources.files import replay_records, text_lines
from rillflow.sources.state import scaled_state, state_rows
from rillflow.streaming.fanout import read_branch
from rillflow.streaming.progress import progress_table, recorded
from rillflow.streaming.runner import catch_up, finish, running
from rillflow.streaming.sinks import (
    AVAILABLE_NOW,
    latest,
    read_snapshot,
    read_update_log,
    to_record_files,
    to_snapshots,
    to_update_log,
)

SEGMENT = "BUILDING"
# Cents are exact in this type, so the sums do not depend on the order of the tasks.
EXACT = "decimal(18,4)"
# Arrivals of a staged stream, and the files that one of its batches holds at most.
SLOTS = 4
BATCH_FILES = 1000
# JSON text in the shared scratch folder shrinks about fivefold, at little cost in time.
SCRATCH_CODEC = "lz4"
# Slots are written side by side: no task sorts its records, which are wide, by their slot first. Row
# groups are small, since a task then holds one for every slot.
SIDE_BY_SIDE = {"spark.sql.maxConcurrentOutputFileWriters": str(SLOTS)}
ROW_GROUP = 32 * 2**20


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# Transforms on tables.


def q_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(tables.table(spark, sf_dir, "documents").select(F.col("text").alias("value")))


def q_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    records = events.select(F.col("event_id").alias("key"), F.col("props").alias("value"))
    decoded = decode_json(records, {"k": "int"}, key_as="event_id")
    return decoded.select(F.col("event_id").cast("bigint"), "k")


def q_decode_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and JSON in one topic: what is not a JSON object decodes to nulls and drops nothing."""
    events = tables.table(spark, sf_dir, "events").select(
        F.lit("events").alias("key"), F.col("props").alias("value")
    )
    prose = tables.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("key"), F.col("text").alias("value")
    )
    decoded = decode_json(events.union(prose), {"k": "int"}, key_as="source", metric="mixed")
    return decoded.groupBy("source").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("k").isNull()).alias("blank_count")
    )


def q_decode_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same topic as a stream: what is blank lands in a quarantine with its bytes and origin."""
    events = tables.table(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"), F.col("props").cast("binary").alias("value"),
    )
    prose = tables.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("topic"), F.lit(1).alias("partition"),
        F.col("doc_id").alias("offset"), F.col("text").cast("binary").alias("value"),
    )
    work = scratch_dir(spark, "decode_quarantine")

    def start(records: DataFrame) -> StreamingQuery:
        paths = f"{work}/out", f"{work}/checkpoint"
        return jobs.decode_or_quarantine(
            records, {"k": "int"}, *paths, None, AVAILABLE_NOW, SCRATCH_CODEC
        )

    _arrive(_by_hash(events.union(prose)), work, start)
    rows = read_branch(spark, f"{work}/out", "quarantine", {**jobs.ORIGIN, "raw": "binary"})
    return rows.withColumn("raw", F.col("raw").cast("string"))


def q_trade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return jobs.trade_windows(tables.trade_records(tables.table(spark, sf_dir, "events")))


def q_sensor_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return jobs.sensor_windows(tables.sensor_records(tables.table(spark, sf_dir, "events")))


def q_sensor_max_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of sensor sends times in another format: its readings enter no window."""
    _utc(spark)
    odd = F.when(F.col("event_type") == "signup", F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    time = odd.otherwise(F.date_format("ts", TIME_FORMAT))
    events = tables.table(spark, sf_dir, "events")
    return jobs.sensor_windows(tables.sensor_records(events, time))


def q_invoice_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return jobs.flat_items(tables.invoice_records(spark, sf_dir))


def q_published_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    records = jobs.item_records(tables.invoice_records(spark, sf_dir), codec="json")
    return decode_json(records, PUBLISHED_ITEM)


def _decode_notifications(records: DataFrame) -> DataFrame:
    """Compare fields, not JSON text: engines print doubles differently."""
    return decode_json(records, NOTIFICATION, key_as="InvoiceNumber")


def q_loyalty_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.order_records(tables.table(spark, sf_dir, "orders"))
    return _decode_notifications(jobs.notifications(records))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.card_rewards(tables.item_records(spark, sf_dir), "json", SEGMENT, EXACT)


def _plain_rewards(rewards: DataFrame) -> DataFrame:
    return rewards.withColumn("TotalPurchase", F.col("TotalPurchase").cast("double"))


def q_prime_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_rewards(_rewards(spark, sf_dir))


def q_rewards_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = encode_json(_rewards(spark, sf_dir), "CustomerCardNo")
    return decode_json(records, REWARD, key_as="key")


# Jobs as streams. What they read is staged in slots that arrive one after the other; the job is
# run to the end of what is there and started anew from its checkpoint when the next has arrived.


def _by_hash(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Slots for jobs in which the order of arrival does not matter."""
    return records.withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(slots)))


def _by_time(events: DataFrame, late: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """Slots of equal parts of the time span; ``late`` says how many slots later a row arrives."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros)).scalar(), events.agg(F.max(micros)).scalar()
    width = F.greatest(F.lit(1), F.call_function("div", last - first, F.lit(slots)))
    own = F.least(F.call_function("div", micros - first, width), F.lit(slots - 1))
    late = F.lit(0) if late is None else late
    return events.withColumn("slot", F.coalesce(F.least(own + late, F.lit(slots - 1)), F.lit(0)))


def _arrive(
    records: DataFrame,
    work: str,
    start: Callable[[DataFrame], StreamingQuery | list[StreamingQuery]],
    also: dict[str, str] | None = None,
    slots: int = SLOTS,
) -> None:
    """Stage ``records`` by their ``slot`` and run the job that ``start`` starts on a stream of them.

    Written once: each run reads a wider choice of the staged folders and finds in its checkpoint
    what it has read. A batch holds a bounded number of files.
    """
    spark, staged = records.sparkSession, f"{work}/staged"
    with settings(spark, SIDE_BY_SIDE):
        rows = records.write.partitionBy("slot").option("parquet.block.size", ROW_GROUP)
        rows.parquet(staged)
    for slot in range(slots):
        arrived = f"{staged}/slot=[0-{slot}]"
        finish(start(replay_records(spark, arrived, BATCH_FILES, also)))


def _run_to_work(records: DataFrame, name: str, start: Callable, **log: object) -> str:
    """Run an update-mode job into an update log; gives the folder of its ``log`` and ``checkpoint``."""
    work = scratch_dir(records.sparkSession, name)
    sink = partial(to_update_log, path=f"{work}/log", **log)
    common = {"sink": sink, "name": None, "trigger": AVAILABLE_NOW}
    _arrive(records, work, partial(start, checkpoint=f"{work}/checkpoint", **common))
    return work


def _run_to_log(records: DataFrame, name: str, start: Callable, keys: list[str]) -> DataFrame:
    """Run an update-mode job into an update log and give the newest row per key."""
    work = _run_to_work(records, name, start)
    return latest(records.sparkSession.read.parquet(f"{work}/log"), keys)


def _run_to_append(records: DataFrame, name: str, start: Callable) -> DataFrame:
    """Run an append-mode job: closed windows come out once."""
    spark = records.sparkSession
    work = scratch_dir(spark, name)
    sink = partial(to_update_log, path=f"{work}/log", mode="append")
    common = {"sink": sink, "name": None, "trigger": AVAILABLE_NOW}
    _arrive(records, work, partial(start, checkpoint=f"{work}/checkpoint", **common))
    return spark.read.parquet(f"{work}/log").drop("batch_id")


def _sensor_arrivals(spark: SparkSession, sf_dir: str, late: Column | None = None) -> DataFrame:
    _utc(spark)
    events = _by_time(tables.table(spark, sf_dir, "events"), late)
    return tables.sensor_records(events, keep=("slot",))


def q_sensor_max_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _sensor_arrivals(spark, sf_dir)
    keys = ["SensorID", "start", "end"]
    return _run_to_log(records, "sensor_max_update", jobs.track_sensors, keys)


def q_sensor_max_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only closed windows come out, once each."""
    records = _sensor_arrivals(spark, sf_dir)
    return _run_to_append(records, "sensor_max_append", jobs.track_sensors)


def q_trade_totals_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    records = _by_hash(tables.trade_records(tables.table(spark, sf_dir, "events")))
    return _run_to_log(records, "trade_totals_update", jobs.total_trades, ["start", "end"])


def q_trade_totals_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bound on lateness, closed windows come out once and leave the state."""
    _utc(spark)
    events = _by_time(tables.table(spark, sf_dir, "events"))
    records = tables.trade_records(events, keep=("slot",))
    start = partial(jobs.total_trades, delay="1 hour")
    return _run_to_append(records, "trade_totals_append", start)


def q_word_count_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    work = scratch_dir(spark, "word_count_complete")
    sink = partial(to_snapshots, path=f"{work}/words")

    def start(lines: DataFrame) -> StreamingQuery:
        values = lines.select(F.col("value").cast("string").alias("value"))
        return jobs.count_words(values, f"{work}/checkpoint", sink, None, AVAILABLE_NOW)

    _arrive(_by_hash(texts), work, start)
    return read_snapshot(spark, f"{work}/words")


def q_word_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job on a directory of text files that fills slot by slot."""
    texts = tables.table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    work = scratch_dir(spark, "word_count_lines")
    sink = partial(to_snapshots, path=f"{work}/words")
    staged = _by_hash(texts.where("value is not null"))
    staged.write.partitionBy("slot").text(f"{work}/in", lineSep="\n")
    for slot in range(SLOTS):
        lines = text_lines(spark, f"{work}/in/slot=[0-{slot}]", BATCH_FILES, lineSep="\n")
        finish(jobs.count_words(lines, f"{work}/checkpoint", sink, None, AVAILABLE_NOW))
    return read_snapshot(spark, f"{work}/words")


def _invoice_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested invoices as a topic; kept as files, since nesting needs a whole table."""
    _utc(spark)
    return _by_hash(tables.invoice_records(spark, sf_dir))


def _flatten_files(
    spark: SparkSession, sf_dir: str, name: str, fields: dict[str, str] | None
) -> DataFrame:
    _utc(spark)
    work = scratch_dir(spark, name)
    nested = tables.invoices(spark, sf_dir).drop(tables.FIRST_PAGE)
    nested = nested.withColumn("slot", F.pmod(F.xxhash64("InvoiceNumber"), F.lit(SLOTS)))
    with settings(spark, SIDE_BY_SIDE):
        nested.write.partitionBy("slot").json(f"{work}/in", compression=SCRATCH_CODEC)
    for slot in range(SLOTS):
        query = jobs.flatten_files(
            spark,
            f"{work}/in/slot=[0-{slot}]",
            f"{work}/out",
            f"{work}/checkpoint",
            archive_dir=f"{work}/archive",
            fields=fields,
            max_files=BATCH_FILES,
            name=None,
            trigger=AVAILABLE_NOW,
            compression=SCRATCH_CODEC,
            schema_dir=f"{work}/schema",
        )
        finish(query)
    archived = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if archived.load(f"{work}/archive").select("path").isEmpty():
        raise RuntimeError("files that were read have not been archived")
    return spark.read.schema(ddl(FLAT_ITEM)).json(f"{work}/out")


def q_file_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON directory to JSON directory, archiving what has been read."""
    return _flatten_files(spark, sf_dir, "file_flatten", INVOICE)


def q_file_flatten_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the schema taken from the files: each is read once more, before its own batch."""
    return _flatten_files(spark, sf_dir, "file_flatten_inferred", None)


def q_record_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "record_flatten")
    paths = f"{work}/out", f"{work}/checkpoint"

    def start(records: DataFrame) -> StreamingQuery:
        return jobs.flatten_records(records, *paths, None, AVAILABLE_NOW, SCRATCH_CODEC)

    _arrive(_invoice_arrivals(spark, sf_dir), work, start)
    return spark.read.schema(ddl(FLAT_ITEM)).json(f"{work}/out")


def q_loyalty_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "loyalty_stream")
    sink = partial(to_record_files, path=f"{work}/out")

    def start(records: DataFrame) -> StreamingQuery:
        return jobs.notify(records, f"{work}/checkpoint", sink, None, AVAILABLE_NOW)

    _arrive(_by_hash(tables.order_records(tables.table(spark, sf_dir, "orders"))), work, start)
    return _decode_notifications(spark.read.parquet(f"{work}/out"))


def q_publish_and_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs joined by a topic: invoices to published items, those to rewards per card."""
    work = scratch_dir(spark, "publish_and_reward")
    items = partial(to_record_files, path=f"{work}/items")
    log = partial(to_update_log, path=f"{work}/log")
    common = {"codec": "json", "name": None, "trigger": AVAILABLE_NOW}
    rewarded = {"segment": SEGMENT, "total_type": EXACT, **common}

    def start(records: DataFrame) -> list[StreamingQuery]:
        finish(jobs.publish_items(records, f"{work}/publish", items, **common))
        published = replay_records(spark, f"{work}/items", BATCH_FILES)
        return [jobs.reward_cards(published, f"{work}/reward", log, **rewarded)]

    _arrive(_invoice_arrivals(spark, sf_dir), work, start)
    return decode_json(latest(spark.read.parquet(f"{work}/log"), ["key"]), REWARD)


def _few_commits(spark: SparkSession) -> dict[str, str]:
    """Settings of a stateful query that ends with each arrival: fewer commits of its state.

    Every state partition commits in every batch, whatever it holds: at most four for each core, and
    no batch without rows after each arrival, as the next one drops what has expired.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewer = min(partitions, 4 * spark.sparkContext.defaultParallelism)
    return {
        "spark.sql.shuffle.partitions": str(fewer),
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }


def q_rewards_delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two jobs with every tenth published item delivered twice; it still counts once."""
    _utc(spark)
    work = scratch_dir(spark, "rewards_delivered_once")
    day = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    span = tables.table(spark, sf_dir, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    width = (span.b - span.a) // SLOTS + 1
    slot = F.call_function("div", F.col("CreatedTime") - span.a, F.lit(width)).alias("slot")
    records = tables.invoice_records(spark, sf_dir, also=[F.coalesce(slot, F.lit(0)).alias("slot")])

    def twice(items: DataFrame, **options: object) -> StreamingQuery:
        tenth = F.pmod(F.xxhash64("value"), F.lit(10)) == 0
        copies = F.explode(F.when(tenth, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        delivered = items.select("key", "value", copies.alias("copy")).drop("copy")
        return to_record_files(delivered, f"{work}/items", **options)

    log = partial(to_update_log, path=f"{work}/log")
    common = {"codec": "json", "name": None, "trigger": AVAILABLE_NOW}
    # Slots follow event time, so that within one of them nothing is later than its width.
    rewarded = {"segment": SEGMENT, "total_type": EXACT, "once_within": f"{width} milliseconds", **common}

    def start(records: DataFrame) -> list[StreamingQuery]:
        finish(jobs.publish_items(records, f"{work}/publish", twice, line_ids=True, **common))
        published = replay_records(spark, f"{work}/items", BATCH_FILES)
        with settings(spark, _few_commits(spark)):
            finish(jobs.reward_cards(published, f"{work}/reward", log, **rewarded))
        return []

    _arrive(records, work, start)
    return decode_json(latest(spark.read.parquet(f"{work}/log"), ["key"]), REWARD)


def _split(spark: SparkSession, sf_dir: str, name: str, single_read: bool) -> str:
    """Run the fan-out and give the folder that its two sinks are in."""
    work = scratch_dir(spark, name)

    def start(records: DataFrame) -> list[StreamingQuery]:
        return jobs.split_invoices(
            records,
            f"{work}/out",
            f"{work}/checkpoint",
            single_read,
            AVAILABLE_NOW,
            SCRATCH_CODEC,
            tables.FIRST_PAGE,
        )

    also = {tables.FIRST_PAGE: "boolean"}
    _arrive(_invoice_arrivals(spark, sf_dir), work, start, also)
    return f"{work}/out"


def _split_sink(spark: SparkSession, out: str, single_read: bool, sink: str) -> DataFrame:
    fields = {"invoice": FLAT_ITEM, "notification": {"key": "string", "value": "string"}}[sink]
    if single_read:
        return read_branch(spark, out, sink, fields)
    return spark.read.schema(ddl(fields)).json(f"{out}/{sink}")


def _split_counts(spark: SparkSession, out: str, single_read: bool) -> DataFrame:
    """How much reached each of the two sinks: line items and notified invoices."""
    sinks = {s: _split_sink(spark, out, single_read, s) for s in ("invoice", "notification")}
    counts = [
        rows.agg(F.count("*").alias("row_count")).select(F.lit(sink).alias("sink"), "row_count")
        for sink, rows in sinks.items()
    ]
    return counts[0].union(counts[1])


def q_fan_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(spark, _split(spark, sf_dir, "fan_out", False), False)


def q_fan_out_single_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(spark, _split(spark, sf_dir, "fan_out_single_read", True), True)


def q_fan_out_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_sink(spark, _split(spark, sf_dir, "fan_out", False), False, "invoice")


def q_fan_out_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _split(spark, sf_dir, "fan_out", False)
    return _decode_notifications(_split_sink(spark, out, False, "notification"))


def q_fan_out_single_read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_sink(spark, _split(spark, sf_dir, "fan_out_single_read", True), True, "invoice")


def q_fan_out_single_read_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _split(spark, sf_dir, "fan_out_single_read", True)
    return _decode_notifications(_split_sink(spark, out, True, "notification"))


def q_sensor_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives, some a quarter of the whole time span late; the stream is restarted.

    Events with a high ``k`` arrive with the slot after their own. By then windows are closed up to
    30 minutes before the latest event seen.
    """
    late = (F.get_json_object("props", "$.k").cast("int") >= 90).cast("int")
    records = _sensor_arrivals(spark, sf_dir, late)
    keys = ["SensorID", "start", "end"]
    return _run_to_log(records, "sensor_late_data", jobs.track_sensors, keys)


def q_late_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrivals, as told by the reports of their batches: rows read, and late groups dropped.

    An arrival is one run of the job. What is late is dropped after it was aggregated: a group is a
    sensor and a window.
    """
    late = (F.get_json_object("props", "$.k").cast("int") >= 90).cast("int")
    records = _sensor_arrivals(spark, sf_dir, late)
    work = scratch_dir(spark, "late_rows_dropped")
    sink = partial(to_update_log, path=f"{work}/log")
    common = {"sink": sink, "trigger": AVAILABLE_NOW, "checkpoint": f"{work}/checkpoint"}
    # Reports are kept of this query's own name.
    name = work.rpartition("/")[2]
    with recorded(spark, f"{work}/progress", {name}):
        _arrive(records, work, partial(jobs.track_sensors, name=name, **common))
    runs = progress_table(spark, f"{work}/progress").groupBy("run").agg(
        F.min("batch").alias("first"), F.sum("rows_in").alias("rows_in"), F.sum("dropped").alias("dropped")
    )
    # As many rows as arrivals.
    arrival = (F.row_number().over(Window.orderBy("first")) - 1).cast("bigint")
    return runs.select(arrival.alias("arrival"), "rows_in", "dropped")


def q_sensor_state_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows still in the state when all has arrived: closed ones have left it."""
    records = _sensor_arrivals(spark, sf_dir)
    with scaled_state(spark):
        work = _run_to_work(records, "sensor_state_left", jobs.track_sensors)
    rows = state_rows(spark, f"{work}/checkpoint")
    return rows.select(
        "key.SensorID", "key.window.start", "key.window.end", F.col("value.max").alias("MaxReading")
    )


def q_word_state_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word ever read is in the state: nothing bounds a running count."""
    texts = tables.table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    work = scratch_dir(spark, "word_state_left")
    sink = partial(to_update_log, path=f"{work}/log")

    def start(lines: DataFrame) -> StreamingQuery:
        values = lines.select(F.col("value").cast("string").alias("value"))
        return jobs.count_words(values, f"{work}/checkpoint", sink, None, AVAILABLE_NOW)

    with scaled_state(spark):
        _arrive(_by_hash(texts), work, start)
    rows = state_rows(spark, f"{work}/checkpoint")
    return rows.select("key.value", F.col("value.count").alias("count"))


def q_trade_log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade totals in an update log that is merged into a base after every second batch."""
    _utc(spark)
    records = _by_hash(tables.trade_records(tables.table(spark, sf_dir, "events")))
    keys = ["start", "end"]
    compacted = {"keys": keys, "compact_every": 2}
    work = _run_to_work(records, "trade_log_compacted", jobs.total_trades, **compacted)
    return latest(read_update_log(spark, f"{work}/log"), keys).drop("batch_id")


def _while_running(spark: SparkSession, sf_dir: str, name: str, trigger: str | None) -> DataFrame:
    """Trade totals by a query that keeps running while the slots arrive, and is stopped at the end."""
    _utc(spark)
    records = _by_hash(tables.trade_records(tables.table(spark, sf_dir, "events")))
    work = scratch_dir(spark, name)
    staged, arrived = f"{work}/staged", f"{work}/arrived"
    records.write.partitionBy("slot").parquet(staged)
    fields = spark.read.parquet(staged).drop("slot").schema
    spark.createDataFrame([], fields).write.parquet(arrived)
    sink = partial(to_update_log, path=f"{work}/log")
    stream = replay_records(spark, arrived, BATCH_FILES)
    query = jobs.total_trades(stream, f"{work}/checkpoint", sink, name=None, trigger=trigger)
    with running(query):
        for slot in range(SLOTS):
            rows = spark.read.schema(fields).parquet(f"{staged}/slot={slot}")
            rows.write.mode("append").parquet(arrived)
            catch_up(query)
    return latest(spark.read.parquet(f"{work}/log"), ["start", "end"])


def q_trade_totals_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _while_running(spark, sf_dir, "trade_totals_interval", "1 second")


def q_trade_totals_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an interval each batch starts as soon as there is something to read."""
    return _while_running(spark, sf_dir, "trade_totals_at_once", None)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "word_count": q_word_count,
    "json_decode": q_json_decode,
    "decode_malformed": q_decode_malformed,
    "decode_quarantine": q_decode_quarantine,
    "trade_totals": q_trade_totals,
    "sensor_max": q_sensor_max,
    "sensor_max_undated": q_sensor_max_undated,
    "invoice_flatten": q_invoice_flatten,
    "published_items": q_published_items,
    "loyalty_notifications": q_loyalty_notifications,
    "prime_rewards": q_prime_rewards,
    "rewards_encoded": q_rewards_encoded,
    "sensor_max_update": q_sensor_max_update,
    "sensor_max_append": q_sensor_max_append,
    "trade_totals_update": q_trade_totals_update,
    "trade_totals_append": q_trade_totals_append,
    "word_count_complete": q_word_count_complete,
    "word_count_lines": q_word_count_lines,
    "file_flatten": q_file_flatten,
    "file_flatten_inferred": q_file_flatten_inferred,
    "record_flatten": q_record_flatten,
    "loyalty_stream": q_loyalty_stream,
    "publish_and_reward": q_publish_and_reward,
    "rewards_delivered_once": q_rewards_delivered_once,
    "fan_out_counts": q_fan_out_counts,
    "fan_out_single_read": q_fan_out_single_read,
    "fan_out_items": q_fan_out_items,
    "fan_out_notifications": q_fan_out_notifications,
    "fan_out_single_read_items": q_fan_out_single_read_items,
    "fan_out_single_read_notifications": q_fan_out_single_read_notifications,
    "sensor_late_data": q_sensor_late_data,
    "late_rows_dropped": q_late_rows_dropped,
    "sensor_state_left": q_sensor_state_left,
    "word_state_left": q_word_state_left,
    "trade_log_compacted": q_trade_log_compacted,
    "trade_totals_interval": q_trade_totals_interval,
    "trade_totals_at_once": q_trade_totals_at_once,
}
