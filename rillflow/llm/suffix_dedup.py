"""Repeated passages by sparse suffix arrays.

A passage repeats if a window of ``min_words`` words occurs at two places. Only the suffixes that
begin at minimisers are kept: of every ``SPAN`` word sequences in a row, the one with the smallest
hash, so that both copies of a window choose the same place in it, within its first ``SPAN`` words.
Each kept suffix stands for the windows that chose it. It is sorted by the hash of the words that
follow in all those windows, then by the hash of everything they cover, and compared with its
neighbours: neighbours equal in all of it repeat as a whole, neighbours equal only in what follows
are extended left and right, window by window. Sorting is by range over all columns, so a passage
that a third of all documents share is cut into as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import arrow_schema, keeps_columns, staged, texts_of

MIN_WORDS = 50
# Words of the sequences among which minimisers are chosen, and how many of them in a row.
GRAM = 5
SPAN = 24
# Bytes of text hashed at once.
BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, words between ASCII white space, and a 64-bit hash of it.

    A-Z count as a-z. ``raw`` holds UTF-8 bytes and ends with white space.
    """
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends[:0], np.zeros(0, np.uint64)
    ends = ends[: len(starts)]
    value = _BYTES[_LOWER[raw]]
    value[gap] = 0
    from_start = np.repeat(starts, np.diff(np.append(starts, len(raw))))
    place = np.arange(starts[0], len(raw)) - from_start
    value = value[starts[0] :]
    value *= _powers(_BASES[0], int(place.max()) + 1)[place]
    sums = np.add.reduceat(value, starts - starts[0])
    return starts, ends, _mixed(sums + (ends - starts).astype(np.uint64) * _BASES[1])


class Rolling:
    """Hashes of stretches of words, by prefix sums."""

    def __init__(self, words: np.ndarray, lane: int = 0) -> None:
        n = len(words) + 1
        base = _BASES[lane]
        self.powers = _powers(base, n)
        self.inverse = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
        salted = words if lane == 0 else _mixed(words + _BASES[1])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(salted * self.powers[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        stretch = (self.sums[start + size] - self.sums[start]) * self.inverse[start]
        return _mixed(stretch + np.asarray(size).astype(np.uint64))


def chosen(grams: np.ndarray, windows: int, span: int) -> np.ndarray:
    """For each of the first ``windows`` places, the leftmost smallest of ``span`` grams from it."""
    packed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        packed = np.minimum(packed[: len(packed) - step], packed[step:])
        width += step
    return (packed[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows whose texts come to about BLOCK_BYTES."""
    some, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        some.append(i)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _windows(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, the first word of each text, and all window starts."""
    raws = [t.encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    starts, _, words = words_of(raw)
    begins = np.searchsorted(starts, np.cumsum([0, *map(len, raws)]))
    sizes = np.diff(begins)
    counts = np.maximum(sizes - min_words + 1, 0)
    firsts = np.repeat(begins[:-1], counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return words, begins, firsts + within


def _span_for(min_words: int) -> tuple[int, int]:
    gram = min(GRAM, min_words)
    return gram, max(1, min(SPAN, min_words - gram + 1))


SUFFIXES = "ahead long, whole long, row_no long, first long, starts int"


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The kept suffixes of ``row_no, text``: SUFFIXES.

    ``first`` is the first of the ``starts`` windows in a row that chose this place; ``ahead``
    hashes the words behind the place that all of them hold, with the windows' distances to it;
    ``whole`` hashes all words the windows cover.
    """
    gram, span = _span_for(min_words)
    schema = arrow_schema(SUFFIXES)

    def block(rows: list[int], texts: list[str], numbers: np.ndarray) -> pa.RecordBatch:
        words, begins, windows = _windows(texts, min_words)
        if not len(windows):
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        rolling = Rolling(words)
        grams = rolling.of(np.arange(len(words) - gram + 1), gram)
        place = chosen(grams, len(grams) - span + 1, span)[windows]
        new = np.flatnonzero(np.diff(place, prepend=-1) | (np.diff(windows, prepend=-2) != 1))
        first, at = windows[new], place[new]
        count = np.diff(np.append(new, len(windows)))
        ahead = rolling.of(at, min_words - span + 1)
        back = (at - first).astype(np.uint64)
        whole = rolling.of(first, count + min_words - 1) ^ _mixed(back + ahead)
        doc = np.searchsorted(begins, first, "right") - 1
        columns = [
            ahead.view(np.int64),
            whole.view(np.int64),
            numbers[rows][doc],
            first - begins[doc],
            count.astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for rows in _blocks(texts):
                yield block(rows, [texts[i] for i in rows], numbers)

    return docs.select("row_no", "text").mapInArrow(run, SUFFIXES)


FOUND = "row_no long, first long, starts int, later boolean, extend boolean, again boolean"


def _compare(kept: DataFrame) -> DataFrame:
    """Sort suffixes and compare neighbours: FOUND.

    ``again``: equal to a neighbour in all the windows cover; ``later``: and not the first of
    those. ``extend``: the first of its equals, and other windows go on alike, or may do so in
    the neighbouring task: its windows are to be compared one by one.
    """
    schema = arrow_schema(FOUND)

    def compare(table: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        ahead, whole = (table.column(n).to_numpy() for n in ("ahead", "whole"))
        new_ahead = np.ones(len(ahead), bool)
        new_ahead[1:] = ahead[1:] != ahead[:-1]
        new = new_ahead.copy()
        new[1:] |= whole[1:] != whole[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        run = np.cumsum(new_ahead) - 1
        kinds = np.bincount(run, new)[run]
        extend = new & (kinds > 1)
        # A run of equals at an edge of the task may go on in the next one.
        extend |= new & ((first & (run == 0)) | (last & (run == run[-1])))
        columns = [
            table.column("row_no").to_numpy(),
            table.column("first").to_numpy(),
            table.column("starts").to_numpy(),
            ~new,
            extend,
            size > 1,
        ]
        keep = extend | (size > 1)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Hold back the last run of a batch, which may go on in the next; a run longer than a
            # batch is given out in parts whose first suffixes are extended.
            table = pa.Table.from_batches([*held, batch])
            ahead = table.column("ahead").to_numpy()
            cut = int(np.flatnonzero(ahead != ahead[-1])[-1]) + 1 if ahead[0] != ahead[-1] else 0
            if cut == 0 and table.num_rows > HELD_ROWS:
                yield compare(table, True, True)
                held, first = [], True
                continue
            if cut:
                yield compare(table.slice(0, cut), first, False)
                first = False
            held = table.slice(cut).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held), first, True)

    order = ["ahead", "whole", "row_no", "first"]
    return kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FOUND)


# Equal suffixes compared at once.
HELD_ROWS = 200_000

WINDOWS = "low long, high long, row_no long, first long"


def _each_window(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """Two hashes of every window of the suffixes in ``wanted``: WINDOWS."""
    schema = arrow_schema(WINDOWS)
    places = wanted.groupBy(F.col("row_no").alias("__row")).agg(
        F.collect_list(F.struct("first", "starts")).alias("places")
    )
    rows = docs.join(places, docs["row_no"] == F.col("__row")).select(
        "row_no", "text", "places.first", "places.starts"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text, first, starts in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(np.frombuffer(text.encode() + b"\n", np.uint8))[2]
                count = np.array(starts)
                at = np.repeat(np.array(first), count)
                at += np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                lanes = [Rolling(words, lane).of(at, min_words).view(np.int64) for lane in (0, 1)]
                columns = [*lanes, np.full(len(at), number), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return rows.mapInArrow(run, WINDOWS)


def _joined(places: DataFrame, min_words: int) -> DataFrame:
    """``row_no, start, end`` of the unions of windows, as words, end exclusive."""
    ends = F.col("first") + F.col("starts") + (min_words - 1)
    spans = places.select("row_no", F.col("first").alias("start"), ends.alias("end"))
    order = Window.partitionBy("row_no").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("row_no", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("island")


def repeats(numbered: DataFrame, min_words: int = MIN_WORDS, later: bool = False) -> DataFrame:
    """``row_no, start, end`` of the repeated stretches of ``row_no, text``, in words.

    With ``later`` only what has an equal window earlier, by row_no and place: what can go without
    loss. Null and empty texts and those of fewer than ``min_words`` words have none.
    """
    kept = staged(suffixes(numbered, min_words), "suffixes")
    found = staged(_compare(kept), "suffix-neighbours")
    windows = staged(_each_window(numbered, found.where("extend"), min_words), "suffix-windows")
    first = F.min(F.struct("row_no", "first"))
    twice = windows.groupBy("low", "high").agg(F.count("*").alias("n"), first.alias("head"))
    twice = twice.where("n > 1").select("low", "high", "head")
    singles = windows.join(twice, ["low", "high"])
    if later:
        singles = singles.where("head <> struct(row_no, first)")
    wholes = found.where("later" if later else "again").select("row_no", "first", "starts")
    singles = singles.select("row_no", "first", F.lit(1).alias("starts"))
    return _joined(wholes.union(singles), min_words)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, in order of doc_id as far as copies go."""
    return docs.withColumn("row_no", F.monotonically_increasing_id())


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: a row per repeated stretch of a document.

    Words are numbered from 0 and stand between ASCII white space; A-Z count as a-z. Stretches are
    unions of windows of ``min_words`` words that occur at two places or more, in one document or
    several; those of one document do not touch. Null, empty and short texts have no rows, repeated
    rows repeat each other, rows without doc_id are documents like others. Of equal minimisers the
    leftmost counts, in all copies alike. Very long texts are taken whole; an empty table gives none.
    """
    rows = staged(_numbered(texts_of(docs)), "suffix-rows")
    spans = repeats(rows.select("row_no", "text"), min_words)
    spans = spans.join(rows.select("row_no", "doc_id"), "row_no")
    return spans.select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"),
    )


def _in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``__no`` of their own that follows doc_id.

    That is doc_id itself where it tells all rows apart. Else the rows are sorted and written once,
    rows of one id in the order they are read: null ids come last, in as many tasks as they need.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        return docs.withColumn("__no", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__no")]
    ordered = docs.withColumn("__no", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.withColumn("__no", F.monotonically_increasing_id()), "suffix-docs")


@keeps_columns
def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the stretches that occur earlier: their words are cut out of the text.

    The first window of its kind stays, by doc_id; of rows with one id, or without, the one read
    first. A text that loses all its words goes; others stay as they are, null and empty ones too,
    with ``n_chars`` as long as the new text. Columns are unchanged; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index("text")
    length = names.index("n_chars") if "n_chars" in names else None
    texts_of(docs)
    rows = _in_order(docs)
    numbered = rows.select(F.col("__no").alias("row_no"), "text")
    spans = repeats(numbered, min_words, later=True)
    spans = spans.groupBy(F.col("row_no").alias("__row")).agg(
        F.collect_list(F.struct("start", "end")).alias("__spans")
    )
    joined = rows.join(spans, F.col("__no") == F.col("__row"), "left").select(*names, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            spans = columns.pop().to_pylist()
            texts = columns[at].to_pylist()
            new = [without(t, s) if s else t for t, s in zip(texts, spans)]
            keep = pa.array([not s or n != "" for s, n in zip(spans, new)], pa.bool_())
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                sizes = columns[length].to_pylist()
                sizes = [len(n) if s else size for n, s, size in zip(new, spans, sizes)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return joined.mapInArrow(run, docs.schema)


def without(text: str, spans: list[dict]) -> str:
    """``text`` without some stretches of its words and the white space behind each."""
    raw = text.encode()
    starts = words_of(np.frombuffer(raw + b"\n", np.uint8))[0].tolist()
    starts.append(len(raw))
    out, end = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        out.append(raw[end : starts[span["start"]]])
        end = starts[span["end"]]
    out.append(raw[end:])
    return b"".join(out).decode().strip(" \t\n\r\x0b\x0c")
