"""The nine streaming jobs.

Each takes a source stream and where to write, starts its query and returns it. Records come from
``kafka_records`` or, kept as files, from ``replay_records``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillflow.functions.codecs import (
    decode_avro,
    decode_json,
    decoded_rows,
    encode_avro,
    encode_json,
    quarantined_rows,
)
from rillflow.functions.expressions import with_event_time
from rillflow.operators.aggregates import prime_rewards, word_count
from rillflow.operators.delivery import delivered_once
from rillflow.operators.invoices import (
    FLATTEN_NEEDS,
    LOYALTY_NEEDS,
    PUBLISH_NEEDS,
    flatten_invoices,
    loyalty_notifications,
    published_items,
)
from rillflow.operators.windows import sensor_max, trade_totals
from rillflow.schemas import INVOICE, PUBLISHED_ITEM, PUBLISHED_LINE, SENSOR, TRADE, avro_schema
from rillflow.sources.files import json_dir
from rillflow.sources.inference import kept_schema
from rillflow.streaming.fanout import fan_out, fan_out_single_read
from rillflow.streaming.sinks import to_console, to_json_files, to_kafka

# Topic names and triggers of the jobs.

INVOICES_TOPIC = "invoices"
TRADES_TOPIC = "trades"
SENSOR_TOPIC = "sensor"
NOTIFICATION_TOPIC = "notification"
PUBLISHED_TOPIC = "notification_avro"
REWARDS_TOPIC = "AggregatedRewards"
PUBLISHED_RECORD = "PublishedItem"
MINUTE = "1 minute"
SECOND = "1 second"

# A sink already bound to its target: called with a DataFrame and checkpoint, name, trigger.
Sink = Callable[..., StreamingQuery]


def kafka_sink(servers: str, topic: str, mode: str = "append") -> Sink:
    return partial(to_kafka, servers=servers, topic=topic, mode=mode)


def console_sink(mode: str, rows: int = 20) -> Sink:
    return partial(to_console, mode=mode, rows=rows)


# Decoded and transformed frames, before any sink: the same on tables and on streams. ``metric``
# names the observation of what was decoded; where one query uses a frame twice, give each its own.


def flat_items(records: DataFrame, metric: str = "flattened_records") -> DataFrame:
    return flatten_invoices(decode_json(records, INVOICE, FLATTEN_NEEDS, metric=metric))


def notifications(
    records: DataFrame, metric: str = "notified_records", first_page: str | None = None
) -> DataFrame:
    """Notifications of all records, or of those that the boolean column ``first_page`` marks."""
    if first_page is not None:
        records = records.where(F.col(first_page))
    return loyalty_notifications(decode_json(records, INVOICE, LOYALTY_NEEDS, metric=metric))


def item_records(
    records: DataFrame,
    codec: str = "avro",
    metric: str = "published_records",
    line_ids: bool = False,
) -> DataFrame:
    """``line_ids`` gives every item a ``LineId``, from its record's content and its place there."""
    fields = PUBLISHED_LINE if line_ids else PUBLISHED_ITEM
    if line_ids:
        records = records.withColumn("RecordId", F.md5("value"))
    keep = ["RecordId"] if line_ids else []
    invoices = decode_json(records, INVOICE, PUBLISH_NEEDS, metric=metric, keep=keep)
    items = published_items(invoices, *keep)
    if codec == "avro":
        schema = avro_schema(fields, PUBLISHED_RECORD)
        return encode_avro(items, "InvoiceNumber", list(fields), schema)
    return encode_json(items, "InvoiceNumber")


def card_rewards(
    records: DataFrame,
    codec: str = "avro",
    segment: str = "PRIME",
    total_type: str = "double",
    metric: str = "rewarded_records",
    once_within: str | None = None,
) -> DataFrame:
    """``once_within`` counts an item with a ``LineId`` once, however often it is delivered."""
    fields = PUBLISHED_ITEM if once_within is None else PUBLISHED_LINE
    if codec == "avro":
        # Avro has no field to skip to: the whole record is read whatever is wanted of it.
        items = decode_avro(records, avro_schema(fields, PUBLISHED_RECORD), metric=metric)
    else:
        wanted = ["CustomerType", "CustomerCardNo", "TotalValue"]
        wanted += [] if once_within is None else ["CreatedTime", "LineId"]
        items = decode_json(records, fields, wanted, metric=metric)
    if once_within is not None:
        # Other segments need not be remembered.
        items = delivered_once(items.where(F.col("CustomerType") == segment), once_within)
    return prime_rewards(items, segment, total_type=total_type)


def trade_windows(
    records: DataFrame,
    width: str = "15 minutes",
    delay: str | None = None,
    metric: str = "undated_trades",
) -> DataFrame:
    trades = decode_json(records, TRADE, only=["CreatedTime", "Type", "Amount"])
    return trade_totals(with_event_time(trades, metric=metric), width, delay)


def sensor_windows(
    records: DataFrame,
    width: str = "15 minutes",
    slide: str = "5 minutes",
    delay: str | None = "30 minutes",
    metric: str = "undated_readings",
) -> DataFrame:
    readings = decode_json(records, SENSOR, key_as="SensorID")
    return sensor_max(with_event_time(readings, metric=metric), width, slide, delay)


# The jobs.


def count_words(
    lines: DataFrame,
    checkpoint: str,
    sink: Sink | None = None,
    name: str | None = "word count",
    trigger: str | None = None,
) -> StreamingQuery:
    """Running count of every token, whole result each batch; its state only grows."""
    sink = sink or console_sink("complete")
    return sink(word_count(lines), checkpoint=checkpoint, name=name, trigger=trigger)


def flatten_files(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    archive_dir: str | None = None,
    fields: dict[str, str] | None = None,
    max_files: int | None = None,
    options: dict[str, str] | None = None,
    name: str | None = "flatten files",
    trigger: str | None = MINUTE,
    compression: str | None = None,
    schema_dir: str | None = None,
) -> StreamingQuery:
    """JSON invoices in a directory to JSON line items; inferred schema without ``fields``.

    ``schema_dir`` keeps what was inferred: a restart looks only at files it has not read.
    """
    options = options or {}
    if fields is None and schema_dir is not None:
        schema = kept_schema(spark, path, schema_dir, checkpoint)
        invoices = json_dir(spark, path, schema, archive_dir, max_files, **options)
    else:
        invoices = json_dir(spark, path, fields, archive_dir, max_files, **options)
    items = flatten_invoices(invoices)
    return to_json_files(items, output, checkpoint, name, trigger, compression=compression)


def flatten_records(
    records: DataFrame,
    output: str,
    checkpoint: str,
    name: str | None = "flatten records",
    trigger: str | None = MINUTE,
    compression: str | None = None,
) -> StreamingQuery:
    """Invoice records to JSON line items."""
    items = flat_items(records)
    return to_json_files(items, output, checkpoint, name, trigger, compression=compression)


# Where a record came from.
ORIGIN = {"topic": "string", "partition": "int", "offset": "bigint"}


def decode_or_quarantine(
    records: DataFrame,
    fields: dict[str, str],
    path: str,
    checkpoint: str,
    name: str | None = "decode or quarantine",
    trigger: str | None = MINUTE,
    compression: str | None = None,
) -> StreamingQuery:
    """JSON records to their fields, and those that give none to a quarantine, with their bytes.

    Each record is parsed once. ``read_branch`` gives the branches ``decoded``, with the record's
    origin and ``fields``, and ``quarantine``, with the origin and the ``raw`` bytes; a batch is in
    both or in none.
    """
    rows = decode_json(records, fields, metric="quarantine", keep=list(ORIGIN), quarantine="undecoded")
    branches = {
        "decoded": lambda batch: decoded_rows(batch, "undecoded"),
        "quarantine": lambda batch: quarantined_rows(batch, "undecoded", list(ORIGIN)),
    }
    return fan_out_single_read(rows, branches, path, checkpoint, name, trigger, compression)


def notify(
    records: DataFrame,
    checkpoint: str,
    sink: Sink,
    name: str | None = "loyalty notifications",
    trigger: str | None = MINUTE,
) -> StreamingQuery:
    """Invoice records to loyalty notification records."""
    return sink(notifications(records), checkpoint=checkpoint, name=name, trigger=trigger)


def publish_items(
    records: DataFrame,
    checkpoint: str,
    sink: Sink,
    codec: str = "avro",
    name: str | None = "publish items",
    trigger: str | None = None,
    line_ids: bool = False,
) -> StreamingQuery:
    """Invoice records to one record per line item."""
    items = item_records(records, codec, line_ids=line_ids)
    return sink(items, checkpoint=checkpoint, name=name, trigger=trigger)


def reward_cards(
    records: DataFrame,
    checkpoint: str,
    sink: Sink,
    codec: str = "avro",
    segment: str = "PRIME",
    total_type: str = "double",
    encode: bool = True,
    name: str | None = "reward cards",
    trigger: str | None = None,
    once_within: str | None = None,
) -> StreamingQuery:
    """Published items to running totals per card, changed cards each batch.

    ``encode`` makes keyed JSON records of them; a table sink wants the plain columns. A topic is
    written at least once: with ``once_within`` items published with ``line_ids`` count once.
    """
    rewards = card_rewards(records, codec, segment, total_type, once_within=once_within)
    out = encode_json(rewards, "CustomerCardNo") if encode else rewards
    return sink(out, checkpoint=checkpoint, name=name, trigger=trigger)


def split_invoices(
    records: DataFrame,
    path: str,
    checkpoint: str,
    single_read: bool = False,
    trigger: str | None = SECOND,
    compression: str | None = None,
    first_page: str | None = None,
) -> list[StreamingQuery]:
    """Invoice records to line items and notifications, each into its own JSON directory.

    Two queries, each parsing the fields it needs; with ``single_read`` one query that parses the
    fields of both once. Where a large invoice comes in several records, ``first_page`` names the
    boolean column beside the records that marks the one to notify of.
    """
    if not single_read:
        notified = partial(notifications, first_page=first_page)
        branches = {"invoice": flat_items, "notification": notified}
        return list(fan_out(records, branches, path, checkpoint, trigger, compression).values())
    needs = [*FLATTEN_NEEDS, *LOYALTY_NEEDS]
    keep = [] if first_page is None else [first_page]
    invoices = decode_json(records, INVOICE, needs, metric="split_records", keep=keep)

    def notified(batch: DataFrame) -> DataFrame:
        return loyalty_notifications(batch if first_page is None else batch.where(first_page))

    branches = {"invoice": flatten_invoices, "notification": notified}
    folders = {"path": path, "checkpoint": checkpoint, "compression": compression}
    return [
        fan_out_single_read(invoices, branches, name="split invoices", trigger=trigger, **folders)
    ]


def total_trades(
    records: DataFrame,
    checkpoint: str,
    sink: Sink | None = None,
    width: str = "15 minutes",
    delay: str | None = None,
    name: str | None = "trade totals",
    trigger: str | None = MINUTE,
) -> StreamingQuery:
    """Trade records to bought and sold amounts per window, changed windows each batch.

    Every window is kept for ever unless ``delay`` says how late a trade may be.
    """
    sink = sink or console_sink("update")
    return sink(
        trade_windows(records, width, delay), checkpoint=checkpoint, name=name, trigger=trigger
    )


def track_sensors(
    records: DataFrame,
    checkpoint: str,
    sink: Sink | None = None,
    width: str = "15 minutes",
    slide: str = "5 minutes",
    delay: str | None = "30 minutes",
    name: str | None = "sensor maxima",
    trigger: str | None = MINUTE,
) -> StreamingQuery:
    """Sensor records to the highest reading per sensor and sliding window."""
    sink = sink or console_sink("update")
    return sink(
        sensor_windows(records, width, slide, delay),
        checkpoint=checkpoint,
        name=name,
        trigger=trigger,
    )
