"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. Three letters in a row are bound into one vector by
multiplying the first rotated twice, the second rotated once and the third; a document's vector is
the sum over its three-letter sequences, a language's prototype the sum over its documents. A
document gets the language whose prototype has the largest cosine with its own vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from rillflow.llm.common import keeps_columns, map_batches, texts_of

DIMENSIONS = 1024
SEED = 20_260
# Letters above this code point share vectors.
SYMBOLS = 1024
GAP = 0
# Prototypes are sent to every task: so many languages at most.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
# Sequences whose vectors a Python worker remembers.
CACHE_SEQUENCES = 16_384
# A document is accepted unless its cosine lies so many standard deviations below the mean of labelled
# documents of its length: whatever their distribution, at most one in 37 of those does.
SPREAD = 6.0
# Labelled documents of a length without which nothing is known of the spread there.
MIN_LABELLED = 100
# Cosines are added up as whole numbers of this unit, so that the sums are the same in any order.
UNIT = 10_000


def _letter_table() -> np.ndarray:
    """Symbol per code point: letters their own up to SYMBOLS, shared above; 0 for all others."""
    table = np.zeros(0x110000, np.int64)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    low = letters < SYMBOLS // 2
    table[letters[low]] = letters[low]
    table[letters[~low]] = SYMBOLS // 2 + letters[~low] % (SYMBOLS // 2)
    return table


class Profiler:
    """Three-letter sequences of texts and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.table = _letter_table()
        signs = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dimensions))
        one = (signs * 2 - 1).astype(np.int8)
        self.first, self.second, self.third = np.roll(one, 2, 1), np.roll(one, 1, 1), one
        self.dimensions = dimensions
        self.row_of: dict[int, int] = {}
        self.vectors = np.zeros((CACHE_SEQUENCES, dimensions), np.float32)

    def sequences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a text's three-letter sequences and how often each occurs.

        Everything between letters counts as one gap, and a gap stands before and behind the text.
        """
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        symbols = self.table[points]
        if not symbols.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([[GAP], symbols, [GAP]])
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != GAP) | (padded[:-1] != GAP)
        padded = padded[keep]
        code = (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:]
        return np.unique(code, return_counts=True)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sequences."""
        a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return self.first[a] * self.second[b] * self.third[c]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` that hold the sequences; at most CACHE_SEQUENCES at a time."""
        found = list(map(self.row_of.get, codes.tolist()))
        if None in found:
            new = [i for i, row in enumerate(found) if row is None]
            if len(self.row_of) + len(new) > len(self.vectors):
                self.row_of.clear()
                new = range(len(codes))
            at = len(self.row_of)
            some = codes[list(new)]
            self.vectors[at : at + len(some)] = self.bound(some)
            self.row_of.update(zip(some.tolist(), range(at, at + len(some))))
            found = [self.row_of[c] for c in codes.tolist()]
        return np.array(found, np.int64)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the sequences' vectors."""
        out = np.zeros(self.dimensions, np.float64)
        step = len(self.vectors)
        for i in range(0, len(codes), step):
            rows = self.rows(codes[i : i + step])
            out += counts[i : i + step].astype(np.float32) @ self.vectors[rows]
        return out


_PROFILERS: dict[int, Profiler] = {}


def _profiler(dimensions: int) -> Profiler:
    """One profiler per Python worker."""
    if dimensions not in _PROFILERS:
        _PROFILERS[dimensions] = Profiler(dimensions)
    return _PROFILERS[dimensions]


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the documents, by the CRC of their id; a null id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Prototypes:
    """Unit vectors of the learned languages, in order of their names."""

    names: list[str]
    vectors: np.ndarray


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes from all documents with a language that are not held out.

    Tasks hand on one sum per language, so neither the number of documents nor their lengths
    matter to the driver. Sums are of whole numbers: the same in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = _profiler(dimensions)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text:
                    seen.setdefault(lang, []).append(profiler.sequences(text))
            for lang, found in seen.items():
                codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in found]), len(codes))
                if len(codes):
                    sums[lang] = sums.get(lang, 0) + profiler.bundle(codes, counts)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([n for n in names for _ in range(dimensions)], pa.string()),
                pa.array(list(range(dimensions)) * len(names), pa.int32()),
                pa.array(
                    np.concatenate([sums[n] for n in names]).astype(np.int64) if names else [],
                    pa.int64(),
                ),
            ],
            names=["lang", "place", "value"],
        )

    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = texts_of(known, "lang").mapInArrow(run, "lang string, place int, value long")
    sums = rows.groupBy("lang", "place").agg(F.sum("value").alias("value")).limit(
        (MAX_LANGUAGES + 1) * dimensions
    )
    found: dict[str, np.ndarray] = {}
    for lang, place, value in sums.collect():
        found.setdefault(lang, np.zeros(dimensions))[place] = value
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(found)
    vectors = np.array([found[n] for n in names]).reshape(len(names), dimensions)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(names, vectors / np.where(size > 0, size, 1))


def _nearest(
    profiler: Profiler, prototypes: Prototypes, text: str | None
) -> tuple[str, float, int]:
    """The language with the largest cosine, that cosine, and the number of letter sequences."""
    codes, counts = profiler.sequences(text) if text else ((), ())
    if not len(codes) or not prototypes.names:
        return UNKNOWN, 0.0, 0
    own = profiler.bundle(codes, counts)
    size = np.linalg.norm(own)
    cosines = prototypes.vectors @ own / (size if size > 0 else 1)
    best = int(cosines.argmax())
    return prototypes.names[best], float(cosines[best]), int(counts.sum())


def _predict(profiler: Profiler, prototypes: Prototypes, text: str | None) -> tuple[str, float]:
    name, cosine, _ = _nearest(profiler, prototypes, text)
    return name, min(1.0, max(0.0, cosine))


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs``.

    ``lang_pred`` is ``und`` and the score 0 for a text that is null, empty or has no letter, and for
    all texts if nothing was learned. Equal cosines go to the language first in order of names.
    Repeated rows get equal predictions, very long texts are read whole, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    dimensions = prototypes.vectors.shape[1]

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        profiler = _profiler(dimensions)
        found = [_predict(profiler, shared.value, t) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "held_out": batch.column(2),
            "lang_pred": [n for n, _ in found],
            "score": [s for _, s in found],
        }

    rows = texts_of(docs).withColumn("held_out", held_out(F.col("doc_id")))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return map_batches(rows, run, schema)


def with_language(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """``docs`` with three columns more, row by row: ``__lang``, ``__cosine`` and ``__length``.

    The cosine is not cut at 0. The length is the class of the number of letter sequences: how often
    that can be halved, -1 for none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    dimensions = prototypes.vectors.shape[1]
    at = docs.columns.index("text")
    names = [*docs.columns, "__lang", "__cosine", "__length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = _profiler(dimensions)
        for batch in batches:
            found = [_nearest(profiler, shared.value, t) for t in batch.column(at).to_pylist()]
            named = pa.array([n for n, _, _ in found], pa.string())
            scored = pa.array([c for _, c, _ in found], pa.float64())
            length = pa.array([n.bit_length() - 1 for _, _, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, named, scored, length], names=names)

    more = [
        StructField("__lang", StringType()),
        StructField("__cosine", DoubleType()),
        StructField("__length", IntegerType()),
    ]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def floors(docs: DataFrame, prototypes: Prototypes, spread: float = SPREAD) -> dict[int, float]:
    """Least cosine of an accepted document per class of length.

    From the documents with a language that nothing was learned from. A class with fewer than
    MIN_LABELLED of them takes the floor of the next shorter one that has enough, if there is any.
    Three sums per class reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & held_out(F.col("doc_id")))
    found = with_language(texts_of(known), prototypes).where(F.col("__lang") != UNKNOWN)
    unit = F.round(F.col("__cosine") * UNIT).cast("long")
    sums = found.select("__length", unit.alias("x")).groupBy("__length").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    learned: dict[int, float] = {}
    for length, n, s, q in sums.collect():
        if n >= MIN_LABELLED:
            learned[length] = (s / n - spread * max(0, n * q - s * s) ** 0.5 / n) / UNIT
    for length in range(1, 64):
        if length not in learned and length - 1 in learned:
            learned[length] = learned[length - 1]
    return learned


@keeps_columns
def keep_identified(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The documents in one of the learned languages.

    Learned from the documents themselves; if none has a language, all with a letter stay. What goes
    is ``und``, and documents whose cosine with every language is below the floor of their length,
    see ``floors``: other languages and scripts, random letters, a few words over and over. Short
    documents have cosines so far apart that hardly any is below. Columns and rows are otherwise
    unchanged.
    """
    texts_of(docs)
    prototypes = learn(docs)
    if not prototypes.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = floors(docs, prototypes, spread)
    found = with_language(docs, prototypes).where(F.col("__lang") != UNKNOWN)
    if least:
        floor = F.create_map(*(F.lit(v) for pair in sorted(least.items()) for v in pair))
        below = F.col("__cosine") < F.element_at(floor, F.col("__length"))
        found = found.where(~F.coalesce(below, F.lit(False)))
    return found.select(*docs.columns)
