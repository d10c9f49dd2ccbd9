"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by how often they occur. Each of ``SAMPLES`` independent
samplers draws, for every word, gamma variables that depend on nothing but the word and the
sampler, and keeps the word (with a quantised weight) that comes first. Two documents agree in a
sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import BATCH_ROWS, arrow_schema, map_batches, texts_of

SAMPLES = 64
# Hex digits of one sample in a fingerprint.
DIGITS = 4
# Words whose variables are held at once.
BLOCK = 4096
# Ranges of doc_id per shuffle partition: enough for even tasks.
RANGES_PER_TASK = 8
ACCURACY = 10_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of texts.

    A sampler draws for a word a rate r ~ gamma(2, 1), a start c ~ gamma(2, 1) and a shift b ~
    uniform(0, 1). Weight w reaches level t = floor(ln w / r + b), and the word whose
    c exp(-r (t + 1 - b)) is smallest is taken. Drawn here from three exponentials g, h, f:
    c = g + h, r = ln(c / g) + f and b = f / r have just these distributions (a gamma(2, 1) times a
    uniform is exponential), and at level 0, where all words of weight one are, the order is simply
    that of g, so that such words need no logarithm.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        keys = _mixed(np.arange(1, samples + 1, dtype=np.uint64))
        self.keys = keys.astype(np.uint32) | np.uint32(1)

    def _order(self, words: np.ndarray) -> np.ndarray:
        """A uniform 32-bit number per hashed word and sampler; it stands for g."""
        low, high = words.astype(np.uint32), (words >> np.uint64(32)).astype(np.uint32)
        return _scrambled(low[:, None] * self.keys[None, :] + high[:, None])

    def _heavy(self, order: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The order of words of any weight: as it is at level 0, earlier at higher levels."""
        g = _exponential(order)
        h = _exponential(_scrambled(order + np.uint32(0x9E3779B9)))
        f = _exponential(_scrambled(order + np.uint32(0x3C6EF372)))
        rate = np.log((g + h) / g) + f
        level = np.floor((np.log(weight)[:, None] + f) / rate)
        risen = level > 0
        value = g[risen] * np.exp(-rate[risen] * level[risen])
        out = order.copy()
        out[risen] = (-np.expm1(-value.astype(np.float64)) * 2.0**32).astype(np.uint32)
        return out

    def signature(self, text: str) -> np.ndarray:
        """One 16-bit number per sample; a text without words has its own, all zero.

        The smallest place in the order tells the word and its level, so a scramble of it stands
        for them.
        """
        digests = b"".join(map(xxhash.xxh64_digest, text.encode().lower().split()))
        if not digests:
            return np.zeros(self.samples, np.uint16)
        words, counts = np.unique(np.frombuffer(digests, np.uint64), return_counts=True)
        best = np.full(self.samples, np.iinfo(np.uint32).max)
        often = counts > 1
        for i in range(0, len(words), BLOCK):
            some = slice(i, i + BLOCK)
            order = self._order(words[some])
            heavy = np.flatnonzero(often[some])
            if len(heavy):
                order[heavy] = self._heavy(order[heavy], counts[some][heavy].astype(np.float32))
            np.minimum(best, order.min(0), out=best)
        return np.maximum(_scrambled(best) >> np.uint32(16), 1).astype(np.uint16)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _exponential(bits: np.ndarray) -> np.ndarray:
    """Exponential variables of 32-bit uniform numbers, small ones for small numbers."""
    rest = (~bits >> np.uint32(8)).astype(np.float32)
    return -np.log((rest + np.float32(0.5)) * np.float32(2.0**-24))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, fingerprint``: four hex digits per sample. Null texts count as empty."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        sampler = Sampler(samples)
        found = [_hex(sampler.signature(t or "")) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fingerprint": found}

    return map_batches(texts_of(docs), run, "doc_id long, fingerprint string")


@dataclass(frozen=True)
class Ranges:
    """Ranges of (doc_id, hash of the text): an id that many rows have is split by hash.

    From each of ``ids`` on there are as many ranges as ``splits`` says, which rows of that very id
    share by hash; larger ids go to the last. Rows without id share the first ``nulls`` ranges.
    """

    ids: np.ndarray
    splits: np.ndarray
    nulls: int

    @property
    def split(self) -> bool:
        return self.nulls > 1 or bool((self.splits > 1).any())

    def of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = hashes.to_numpy(zero_copy_only=False) / 2.0**63
        starts = np.concatenate([[0], np.cumsum(self.splits)])
        at = np.searchsorted(self.ids, value, "right")
        own = np.append(self.ids, 0)[at - 1] == value
        splits = np.append(self.splits, 1)[at - 1]
        part = np.where(own, np.minimum(share * splits, splits - 1).astype(np.int64), splits - 1)
        # What lies below all ids has a range of its own.
        number = np.where(at > 0, starts[at - 1] + part, -1) + self.nulls + 1
        first = np.minimum(share * self.nulls, self.nulls - 1).astype(np.int64)
        return np.where(null, first, number)


def _ranges(docs: DataFrame) -> Ranges:
    """Quantiles of doc_id, as many whatever the data.

    An id that is several of them is split as often, but not into less than a batch of rows.
    """
    spark = docs.sparkSession
    wanted = RANGES_PER_TASK * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(
        F.percentile_approx("doc_id", shares, ACCURACY).alias("cuts"),
        F.count("*").alias("rows"),
        F.count("doc_id").alias("ids"),
    ).first()
    ids, splits = np.unique(np.array(found.cuts or [], np.int64), return_counts=True)
    batches = found.rows / wanted / BATCH_ROWS
    nulls = round(wanted * (found.rows - found.ids) / max(1, found.rows))
    splits = np.clip(np.ceil(splits * batches).astype(np.int64), 1, splits)
    return Ranges(ids, splits, max(1, min(nulls, ceil(nulls * batches))))


def _firsts(keys: DataFrame, ranges: Ranges) -> list[tuple[int, int | None, int]]:
    """Each range that has rows, and its smallest doc_id and hash."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        ids, hashes = batch.column(0), batch.column(1)
        return {"range_no": ranges.of(ids, hashes), "doc_id": ids, "text_hash": hashes}

    rows = map_batches(keys, run, "range_no long, doc_id long, text_hash long").groupBy("range_no")
    found = rows.agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).collect()
    return sorted(((r.range_no, *r.first) for r in found), key=lambda r: r[0])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, text, range_no, extra`` in order of doc_id within each range.

    Behind each range stand copies of the first rows of the next range with rows (behind the last,
    of the first), marked ``extra``: every document meets its successor in one task, and nothing
    larger than a batch is held. Null doc_ids come first. Repeated ones come in order of their
    texts; if so many rows have one that they fill several ranges, in order of the texts' hashes.
    """
    plain = texts_of(docs)
    ranges = _ranges(plain.select("doc_id"))
    # Without anything to split the first pass over the keys need not read the texts.
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1) if ranges.split else F.lit(0).cast("long")
    keyed = plain.withColumn("text_hash", hashed)
    firsts = _firsts(keyed.select("doc_id", "text_hash"), ranges)
    before = {tuple(first): firsts[k - 1][0] for k, (_, *first) in enumerate(firsts)}
    heads = pa.array(sorted({first[0] for first in before if first[0] is not None}), pa.int64())
    has_null = any(first[0] is None for first in before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, hashes = batch.columns
            same = pa.array(np.zeros(len(ids), bool))
            number = pa.array(ranges.of(ids, hashes))
            yield pa.RecordBatch.from_arrays([ids, text, hashes, number, same], schema=wanted)
            maybe = pc.is_in(ids, heads).fill_null(False)
            if has_null:
                maybe = pc.or_(maybe, ids.is_null())
            rows = zip(*(c.filter(maybe).to_pylist() for c in (ids, text, hashes)))
            copied = {(i, t, h): before[i, h] for i, t, h in rows if (i, h) in before}
            if copied:
                columns = [*zip(*copied), list(copied.values()), [True] * len(copied)]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, wanted)]
                yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    schema = "doc_id long, text string, text_hash long, range_no long, extra boolean"
    wanted = arrow_schema(schema)
    order = ["range_no", "extra", F.col("doc_id").asc_nulls_first(), "text_hash"]
    rows = keyed.mapInArrow(run, schema).repartition("range_no")
    rows = rows.sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return rows.select("doc_id", "text", "range_no", "extra")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many first ones of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    One row per row of ``docs``, columns as in EDITED; ``near_*`` is the share of equal samples.
    The next document is that with the next doc_id, after the last the first. Null texts count as
    empty, two texts without words are alike. Rows without doc_id come before all others, rows
    with the same one follow each other, in the order that ``with_neighbours`` gives them. An empty
    table gives no rows; whole texts are read, whatever their length.
    """
    names = [field.split()[0] for field in EDITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        last = None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, number, extra in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if extra and (last is None or last[0] != number):
                    continue
                own = sampler.signature(text)
                if last is not None and last[0] == number:
                    out.append(_compared(sampler, last[1:], text, own))
                last = None if extra else (number, doc_id, text, own)
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted
            )

    wanted = arrow_schema(EDITED)
    return with_neighbours(docs).mapInArrow(run, EDITED)


def _compared(
    sampler: Sampler, this: tuple[int | None, str, np.ndarray], following: str, theirs: np.ndarray
) -> tuple:
    doc_id, text, own = this
    new = edited(text, following)
    changed = sampler.signature(new)
    return (
        doc_id,
        len(text),
        hashlib.sha256(new.encode()).hexdigest(),
        _hex(own),
        _hex(changed),
        likeness(own, changed),
        likeness(own, theirs),
    )
