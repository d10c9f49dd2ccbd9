"""Phrases whose words stand together more often than apart, counted with one FM-index per shard.

A shard is a run of documents of one language within one task, as word numbers of its own with a
separator between pieces; no phrase crosses a shard. Its index is bidirectional: the Burrows-Wheeler
transform of the words and that of the words in reverse. A phrase is a pair of intervals of equal
size, one in each; extending it by a word to the left narrows the first through one transform, to the
right the second through the other, and keeps both in step. Sizes are the counts. All phrases of one
length are extended at once.

What is rare everywhere cannot be part of a frequent phrase, so counts of shards are summed level by
level and only what is frequent over all shards goes on: words first, then pairs of frequent words,
then phrases of three and four words all of whose pairs are frequent. Every shard learns which of its
own words and pairs are left from the shuffle that sums them, so nothing that grows with the
vocabulary is broadcast. Where
nothing is rare, a shard gives at most one row per place and length.

A task's memory is bounded by one shard, however many phrases of it are frequent: rows and words are
numbered in 32 bits, and phrases are extended and handed over block by block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import AbstractContextManager
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import LARGE_ROWS, prepare, staged, typed
from rillflow.session import settings

# Words of the longest phrase; suffixes are sorted by as many words.
DEPTH = 4
LEAST = 30
TOP = 2000
# Words after which a shard ends, with the document that holds the last: bounds a task's memory.
SHARD_WORDS = 1 << 21
# The same for the different words of a task's open shards.
SHARD_VOCABULARY = 1 << 19
# A task numbers its shards in so many bits; a word's number within its shard takes 31.
SHARD_BITS = 12
# Rows of one Arrow batch of phrases.
ROWS = 1 << 16
# Places in a shard whose phrases are extended at once, and rows that are told at once.
BLOCK = 1 << 18
# Bytes of one Arrow batch, or a single row if that is larger, as a shard is.
BATCH_BYTES = 4 << 20

_ENDS = b".,;:!?\n\x0b\x0c\r"
_ONE_END = bytes.maketrans(_ENDS, b"." * len(_ENDS))


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, and a full stop, which no word holds, wherever a piece ends."""
    # What is left for ``split`` to part at is the space and the tab.
    return text.lower().translate(_ONE_END).replace(b".", b" . ").split()


def _bounded_batches(spark: SparkSession) -> AbstractContextManager:
    """Arrow batches of a few MB: shards one at a time, phrases by the thousand."""
    prepare(spark)
    rows, size = "maxRecordsPerBatch", "maxBytesPerBatch"
    conf = {rows: str(ROWS), size: str(BATCH_BYTES)}
    return settings(spark, {f"spark.sql.execution.arrow.{key}": value for key, value in conf.items()})


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _width(n: int) -> type[np.unsignedinteger]:
    """The type that numbers below ``n`` are stored in."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _packed(numbers: np.ndarray, n: int) -> pa.Array:
    return pa.array([numbers.astype(_width(n)).tobytes()], pa.binary())


def _unpacked(numbers: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(numbers.as_buffer(), _width(n))


def _kept(lists: pa.Array, row: int) -> np.ndarray:
    """What ``_told`` has for a shard, one row for each pair of numbers; not copied."""
    parts = lists.cast(pa.list_(pa.binary()))[row].values
    if not len(parts):
        return np.empty((0, 2), np.int64)
    _, ends, bytes_ = parts.buffers()
    ends = np.frombuffer(ends, np.int32)[parts.offset : parts.offset + len(parts) + 1]
    return np.frombuffer(bytes_, np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, 2)


def shards(
    docs: DataFrame, shard_words: int = SHARD_WORDS, vocabulary: int = SHARD_VOCABULARY
) -> DataFrame:
    """``shard, lang, words, counts, text``: ``text`` numbers into ``words``, 0 between pieces.

    ``words`` starts with the separator; ``counts`` says how often each stands in the shard. The
    largest shard of a task ends once all of its open ones have ``shard_words`` words, or
    ``vocabulary`` different ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = count(TaskContext.get().partitionId() << SHARD_BITS)
        open_shards: dict[str, tuple[dict, list]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def closed(lang: str) -> pa.RecordBatch:
            numbers, parts = open_shards.pop(lang)
            del sizes[lang]
            no = next(shard)
            if no >> SHARD_BITS != TaskContext.get().partitionId():
                raise ValueError(f"more than {1 << SHARD_BITS} shards in one task: split its input")
            text = np.concatenate([np.zeros(1, np.int32), *parts])
            columns = [
                pa.array([no]),
                pa.array([lang]),
                _one_list(pa.array(list(numbers), pa.binary()).cast(pa.string())),
                _one_list(pa.array(np.bincount(text, minlength=len(numbers)))),
                _packed(text, len(numbers)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "text"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_of(text.as_py() or b"")
                if not found:
                    continue
                if lang not in open_shards:
                    numbers: dict[bytes, int] = defaultdict(count().__next__)
                    numbers[b"."]
                    open_shards[lang] = numbers, []
                numbers, parts = open_shards[lang]
                found.append(b".")
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                sizes[lang] += len(found)
                # One bound for all open shards of the task: there may be many languages.
                different = sum(len(numbers) for numbers, _ in open_shards.values())
                if sum(sizes.values()) >= shard_words or different >= vocabulary:
                    yield closed(max(sizes, key=sizes.__getitem__))
        for lang in list(open_shards):
            yield closed(lang)

    schema = "shard long, lang string, words array<string>, counts array<long>, text binary"
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    return rows.mapInArrow(typed(run, schema), schema)


class Transform(NamedTuple):
    """Rows of one direction: ``lasts`` the word before each suffix, ``back`` the row it leads to."""

    lasts: np.ndarray
    back: np.ndarray


class Phrases(NamedTuple):
    """Bidirectional intervals: first rows in both directions, sizes, and the words, one column each."""

    ahead: np.ndarray
    reverse: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    def only(self, chosen: np.ndarray) -> Phrases:
        return Phrases(*(column[chosen] for column in self))


def _numbers(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int32)


def suffix_rows(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of the suffixes, sorted by ``depth`` words or more; a separator ends a suffix.

    ``text`` ends with a separator. Ranks by one word are doubled to two, four and so on, and only
    suffixes that still tie are sorted again. Separators are told apart by their places.
    """
    order = np.argsort(text, kind="stable").astype(np.int32)
    sorted_text = text[order]
    fresh = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]) | (sorted_text == 0)
    rank = np.empty(len(text), np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, _numbers(len(text)), 0))
    step = 1
    while step < depth:
        # Rows in groups of more than one; none of them has met its separator yet.
        tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True)).astype(np.int32)
        if not len(tied):
            break
        some = order[tied]
        keys = rank[some].astype(np.int64)
        keys *= len(text)
        keys += rank[some + np.int32(step)]
        # In any order where they still tie.
        within = np.argsort(keys)
        order[tied] = some = some[within]
        keys = keys[within]
        del within
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        del keys
        fresh[tied] = new
        rank[some] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2
    return order


def last_words(text: np.ndarray) -> np.ndarray:
    """The transform of ``text``, which starts and ends with a separator."""
    return text[suffix_rows(text) - 1]


def transform(lasts: np.ndarray) -> Transform:
    back = np.empty(len(lasts), np.int32)
    back[np.argsort(lasts, kind="stable")] = _numbers(len(lasts))
    return Transform(lasts, back)


def single_words(lasts: np.ndarray) -> Phrases:
    """The intervals of all single words: the same in both directions."""
    sizes = np.bincount(lasts).astype(np.int32)
    firsts = np.cumsum(sizes, dtype=np.int32) - sizes
    words = np.flatnonzero(sizes[1:]).astype(np.int32) + 1
    return Phrases(firsts[words], firsts[words], sizes[words], words[:, None])


def blocks(phrases: Phrases) -> Iterator[Phrases]:
    """The phrases in order, those at ``BLOCK`` places at a time, or a single one at more."""
    ends = np.cumsum(phrases.sizes, dtype=np.int64)
    at = done = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield phrases.only(slice(at, to))
        at, done = to, int(ends[to - 1])


def _extended(
    index: Transform, firsts: np.ndarray, others: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All extensions of the intervals ``firsts, sizes`` by one word through ``index``.

    Gives the number of the interval, the word, the new first row, that in the other direction and
    the size.
    """
    which = np.repeat(_numbers(len(sizes)), sizes)
    before = np.cumsum(sizes, dtype=np.int32) - sizes
    rows = _numbers(len(which)) + np.repeat(firsts - before, sizes)
    words = index.lasts[rows]
    keys = which.astype(np.int64)
    keys *= int(words.max(initial=0)) + 1
    keys += words
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    new_sizes = np.diff(np.append(starts, len(keys))).astype(np.int32)
    first = order[starts]
    real = words[first] > 0
    starts, new_sizes, first = starts[real].astype(np.int32), new_sizes[real], first[real]
    of = which[first]
    # Rows of an interval are sorted by the new word in the other direction, separators first.
    other = others[of] + starts - before[of]
    return of, words[first].astype(np.int32), index.back[rows[first]], other, new_sizes


def left(ahead: Transform, phrases: Phrases) -> Phrases:
    """Every phrase extended by each word that stands before it."""
    of, words, firsts, others, sizes = _extended(ahead, phrases.ahead, phrases.reverse, phrases.sizes)
    return Phrases(firsts, others, sizes, np.column_stack([words, phrases.words[of]]))


def right(reverse: Transform, phrases: Phrases) -> Phrases:
    """Every phrase extended by each word that stands after it."""
    of, words, firsts, others, sizes = _extended(reverse, phrases.reverse, phrases.ahead, phrases.sizes)
    return Phrases(others, firsts, sizes, np.column_stack([phrases.words[of], words]))


def _inside(firsts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` rows lie in one of the intervals, which do not overlap."""
    steps = np.zeros(n + 1, np.int8)
    steps[firsts] += 1
    # Where one interval ends another may start.
    steps[firsts + sizes] -= 1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


def longer(ahead: Transform, reverse: Transform, pairs: Phrases) -> Iterator[Phrases]:
    """Phrases of three and of four words all of whose pairs are among ``pairs``, block by block."""
    in_ahead = _inside(pairs.ahead, pairs.sizes, len(ahead.lasts))
    in_reverse = _inside(pairs.reverse, pairs.sizes, len(reverse.lasts))
    for some in blocks(pairs):
        three = left(ahead, some)
        three = three.only(in_ahead[three.ahead])
        yield three
        for part in blocks(three):
            four = right(reverse, part)
            yield four.only(in_reverse[four.reverse])


def indexes(texts: DataFrame) -> DataFrame:
    """``shard, ids, ahead, reverse``: the two transforms of every shard.

    ``texts`` has ``shard, text, n_words, kept``; words whose number is not among the kept become
    separators, the others have the id beside their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, text, n_words = (batch.column(c)[i] for c in range(3))
                kept, ids = _kept(batch.column(3), i).T
                order = np.argsort(kept)
                kept, ids = kept[order], np.append(-1, ids[order])
                renumber = np.zeros(n_words.as_py(), _width(len(ids)))
                renumber[kept] = np.arange(1, len(ids))
                text = renumber[_unpacked(text, len(renumber))]
                # A single separator between pieces is enough.
                text = text[np.concatenate([[True], (text[1:] > 0) | (text[:-1] > 0)])]
                transforms = (last_words(text) for text in (text, text[::-1].copy()))
                columns = [pa.array([shard.as_py()]), _one_list(pa.array(ids))]
                columns += [_packed(lasts, len(ids)) for lasts in transforms]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "ids", "ahead", "reverse"])

    schema = "shard long, ids array<long>, ahead binary, reverse binary"
    rows = texts.select("shard", "text", "n_words", "kept")
    return rows.mapInArrow(typed(run, schema), schema)


# The ids of a phrase's words; -1 where it has fewer.
PLACES = ["one", "two", "three", "four"]


def _phrase_batches(ids: np.ndarray, phrases: Phrases, shard: int | None) -> Iterator[pa.RecordBatch]:
    """Phrases by the ids of their words, a bounded number of rows at a time."""
    for at in range(0, len(phrases.sizes), ROWS):
        some = phrases.only(slice(at, at + ROWS))
        columns = [np.ascontiguousarray(column) for column in ids[some.words].T]
        columns.append(some.sizes)
        names = [*PLACES[: some.words.shape[1]], "f"]
        if shard is not None:
            columns.append(np.full(len(some.sizes), shard))
            names.append("shard")
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)


def pairs_of(index: DataFrame) -> DataFrame:
    """``one, two, f, shard``: each shard's phrases of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, ids, reverse = (batch.column(c)[i] for c in range(3))
                ids = ids.values.to_numpy()
                reverse = transform(_unpacked(reverse, len(ids)))
                for words in blocks(single_words(reverse.lasts)):
                    yield from _phrase_batches(ids, right(reverse, words), shard.as_py())

    schema = "one long, two long, f long, shard long"
    return index.select("shard", "ids", "reverse").mapInArrow(typed(run, schema), schema)


def _chosen(reverse: Transform, ids: np.ndarray, kept: np.ndarray) -> Phrases:
    """The phrases of two words that are among ``kept``, by ids, all of which the shard holds."""
    order = np.argsort(ids)
    sorted_ids = ids[order]
    keys = np.empty(len(kept), np.int64)
    for at in range(0, len(kept), ROWS):
        some = order[np.searchsorted(sorted_ids, kept[at : at + ROWS])]
        keys[at : at + ROWS] = some @ [len(ids), 1]
    keys = np.append(np.sort(keys), -1)
    found = []
    for words in blocks(single_words(reverse.lasts)):
        pairs = right(reverse, words)
        own = pairs.words.astype(np.int64) @ [len(ids), 1]
        found.append(pairs.only(keys[np.searchsorted(keys[:-1], own)] == own))
    return Phrases(*(np.concatenate(column) for column in zip(*found)))


def longer_of(index: DataFrame) -> DataFrame:
    """``one, two, three, four, f``: each shard's phrases of three and four words.

    ``index`` has besides the transforms ``kept``, the ids of the words of the pairs that are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ahead, reverse = (batch.column(c)[i] for c in range(3))
                ids = ids.values.to_numpy()
                ahead, reverse = (transform(_unpacked(x, len(ids))) for x in (ahead, reverse))
                for phrases in longer(ahead, reverse, _chosen(reverse, ids, _kept(batch.column(3), i))):
                    # Word 0, the separator, has the id -1.
                    missing = np.zeros((len(phrases.sizes), len(PLACES) - phrases.words.shape[1]), np.int32)
                    padded = phrases._replace(words=np.hstack([phrases.words, missing]))
                    yield from _phrase_batches(ids, padded, None)

    schema = "one long, two long, three long, four long, f long"
    return index.select("ids", "ahead", "reverse", "kept").mapInArrow(typed(run, schema), schema)


def _written(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, f`` of phrases by the ids of their words, joined by spaces."""
    places = [name for name in PLACES if name in phrases.columns]
    for name in places:
        lang = ["lang"] if name == "one" else []
        word = words.select(*lang, F.col("id").alias(name), F.col("word").alias(f"word_{name}"))
        phrases = phrases.join(word, name, "left")
    n = sum((F.col(name) >= 0).cast("int") for name in places)
    phrase = F.concat_ws(" ", *(f"word_{name}" for name in places))
    return phrases.select("lang", phrase.alias("phrase"), n.alias("n_words"), "f")


def _frequent(places: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``places`` whose keys occur ``least`` times over all shards, with that sum as ``f``.

    A key has one row per shard that holds it. They are summed where they meet, in one shuffle,
    since the shards are to be told as well.
    """
    total = F.sum("f").over(Window.partitionBy(*keys))
    return places.withColumn("f", total).where(F.col("f") >= least)


def _told(places: DataFrame, first: str, second: str) -> DataFrame:
    """``shard, kept``: what each shard keeps, pairs of 64-bit numbers packed into a few binaries.

    Lists of numbers would be gathered as an object for each.
    """

    def packed(rows: pa.Table) -> pa.RecordBatch:
        shard, *numbers = (column.to_numpy() for column in rows.columns)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        numbers = np.column_stack([column[order] for column in numbers])
        ends = (np.append(starts, len(shard)) * numbers[0].nbytes).astype(np.int32)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(numbers)]
        told = pa.Array.from_buffers(pa.binary(), len(starts), buffers)
        return pa.RecordBatch.from_arrays([pa.array(shard[starts]), told], ["shard", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= BLOCK:
                yield packed(pa.Table.from_batches(waiting))
                waiting.clear()
        if sum(map(len, waiting)):
            yield packed(pa.Table.from_batches(waiting))

    schema = "shard long, kept binary"
    rows = places.select("shard", *(F.col(name).cast("long").alias(name) for name in (first, second)))
    told = rows.mapInArrow(typed(run, schema), schema)
    return told.groupBy("shard").agg(F.collect_list("kept").alias("kept"))


def count_phrases(
    docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of all phrases of one to four words that occur ``least`` times,
    and ``lang, n``: all words of each language.

    Words are joined by single spaces. A language of null counts as ``und``; null and empty texts
    have no words.
    """
    spark = docs.sparkSession
    with _bounded_batches(spark):
        texts = staged(shards(docs, shard_words), "phrase-shards", LARGE_ROWS)
    sums = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y) - F.col("counts")[0]
    sizes = texts.select("lang", sums.alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    numbered = F.posexplode(F.arrays_zip("words", "counts")).alias("no", "of")
    places = texts.select("shard", "lang", numbered).where("no > 0")
    places = places.select("shard", "lang", "no", F.col("of.words").alias("word"), F.col("of.counts").alias("f"))
    # A word is known by its place in the first shard that has it.
    place = F.shiftleft("shard", 31) + F.col("no")
    places = places.withColumn("id", F.min(place).over(Window.partitionBy("lang", "word")))
    places = staged(_frequent(places, ["lang", "word"], least), "phrase-words")
    words = places.groupBy("lang", "word").agg(F.max("f").alias("f"), F.min("id").alias("id"))
    words = staged(words, "phrase-ids")
    kept = _told(places, "no", "id")
    with _bounded_batches(spark):
        bare = texts.select("shard", "text", F.size("words").alias("n_words"))
        index = staged(indexes(bare.join(kept, "shard")), "phrase-index", LARGE_ROWS)
        places = staged(_frequent(pairs_of(index), ["one", "two"], least), "phrase-pairs")
        kept = _told(places, "one", "two")
        more = longer_of(index.join(kept, "shard")).groupBy(*PLACES).agg(F.sum("f").alias("f"))
        more = staged(more.where(F.col("f") >= least), "phrase-longer")
    pairs = places.groupBy("one", "two").agg(F.max("f").alias("f"))
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "f")
    both = staged(_written(pairs, words).unionByName(_written(more, words)), "phrase-counts")
    return single.unionByName(both), sizes


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(30,0)")


def _slice(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def weakest_cuts(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, cut``: of the cuts of each phrase into two the one with the lowest score.

    ``cut`` holds ``score, k, l, r``. ``phrases`` holds every part of a phrase as well.
    """
    whole = phrases.where("n_words > 1").withColumn("w", F.split("phrase", " "))
    cuts = whole.select(
        "lang", "phrase", "f", "n_words", "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    )
    rest = F.col("n_words") - F.col("k")
    sides = F.explode(
        F.array(
            F.struct(F.lit("l").alias("side"), _slice("w", F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit("r").alias("side"), _slice("w", F.col("k") + 1, rest).alias("part")),
        )
    )
    sides = cuts.select("lang", "phrase", "f", "k", sides.alias("of")).select("*", "of.*")
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    met = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "k")
    met = met.agg(
        F.max("f").alias("f"),
        F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"),
    )
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * _exact("f"), _exact("l") + _exact("r"))
    cut = F.struct(score.alias("score"), "k", "l", "r")
    return met.groupBy("lang", "phrase").agg(F.min(cut).alias("cut"))


def holders(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, held, left_extensions, right_extensions`` of phrases that stand in longer ones.

    ``held`` is the count of the commonest of these; extensions are those with one word more.
    """
    n = F.col("n_words")
    subs = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), n - 1),
                lambda size: F.transform(
                    F.sequence(F.lit(1), n - size + 1),
                    lambda start: F.struct(
                        F.array_join(F.slice("w", start, size), " ").alias("phrase"),
                        ((size == n - 1) & (start == 2)).alias("left"),
                        ((size == n - 1) & (start == 1)).alias("right"),
                    ),
                ),
            )
        )
    )
    parts = phrases.where("n_words > 2").withColumn("w", F.split("phrase", " "))
    parts = parts.select("lang", "f", subs.alias("of")).select("lang", "f", "of.*")
    return parts.groupBy("lang", "phrase").agg(
        F.max("f").alias("held"),
        # A longer phrase may begin and end with the same part: it counts once on each side.
        F.count_if("left").alias("left_extensions"),
        F.count_if("right").alias("right_extensions"),
    )


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, left_extensions, right_extensions``.

    For each language the first ``top`` phrases of two to four words that occur ``a >= least``
    times: by score, then ``a``, both falling, then by the bytes of the phrase, so there are no ties.
    The score is two million times ``a`` over ``l + r``, rounded down, for the cut of the phrase into
    two parts, of counts ``l`` and ``r``, that makes it lowest; of equal ones the first cut. A phrase
    that stands in a longer one with four fifths of its count or more is left out. The extensions
    are the frequent phrases of one word more at the left or right, up to four words.

    Null and empty texts have no words; a null language counts as ``und``; repeated rows count each
    time; other columns are not read. A text, however long, lies in one shard. An empty table gives
    an empty one.
    """
    counted, sizes = count_phrases(docs, least, shard_words)
    phrases = counted.where("n_words > 1")
    rows = phrases.join(weakest_cuts(counted), ["lang", "phrase"])
    rows = rows.join(holders(phrases), ["lang", "phrase"], "left")
    rows = rows.where(F.col("held").isNull() | (100 * _exact("held") < 80 * _exact("f")))
    rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.*", "left_extensions", "right_extensions")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), "phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order))
    first = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    none = F.lit(0).cast("long")
    return first.join(sizes, "lang").select(
        "lang",
        "rank",
        "phrase",
        "a",
        "l",
        "r",
        "n",
        "score",
        F.coalesce("left_extensions", none).alias("left_extensions"),
        F.coalesce("right_extensions", none).alias("right_extensions"),
    )
