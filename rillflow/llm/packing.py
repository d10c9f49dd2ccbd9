"""Packing of tokenised documents into fixed windows by non-negative least squares.

Every document is cut into whole windows and one rest. The histogram of rests, at most ``window``
numbers, is all that the driver sees: it enumerates shallow combinations of lengths that fill a
window, solves for how often to use each so that the histogram is met in the least squares sense
with no negative count, rounds down, and packs what is left over greedily, longest first. The plan
names lengths and counts only; each piece then looks up its place by its length and its rank among
the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm.common import map_batches, staged, texts_of

WINDOW = 4096
END_ID = 2
# Salt of the ranks: the pieces of one length are numbered in so many separate groups.
RANK_GROUPS = 256
# Words whose ids a Python worker remembers.
CACHE_WORDS = 500_000

# What is split and lower-cased here; a text part with any other character goes through the
# tokenizer itself.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_GAPS = re.compile(r"[ \t\n\r]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
_END = "\x01"


class WordEncoder:
    """Ids of a byte-level word BPE with word ends, whole texts, from a tokenizer file.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    parts between ASCII white space, one after the other. Parts are remembered. New ones of common
    characters are split here and merged by rank in one call; all others, and those that may hold a
    special token, go through the tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.slow = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.room = cache_words
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self._build(model["vocab"], [tuple(m) for m in model["merges"]])

    def _build(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Merge ranks over plain bytes; a control byte stands for the word end."""
        letters = _byte_letters()
        end = "</w>"
        names = [letters[b] for b in range(256)]
        names += [n + end for n in names] + [a + b for a, b in merges]
        value = {letter: byte for byte, letter in letters.items()}
        ranks: dict[bytes, int] = {}
        ids = []
        for name in names:
            stem = name.removesuffix(end)
            raw = bytes(value[c] for c in stem) + (_END.encode() if name != stem else b"")
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab[name])
        self.ids = np.array(ids, np.uint32)
        self.is_end = np.zeros(len(ids), bool)
        for raw, rank in ranks.items():
            self.is_end[rank] = len(raw) > 1 and raw.endswith(_END.encode())
        pattern = f"[^{_END}]+{_END}"
        self.fast = tiktoken.Encoding(
            "word", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )

    def _learn(self, parts: Iterable[str]) -> None:
        plain, words = [], []
        for part in parts:
            if _PLAIN.fullmatch(part) and "<|" not in part:
                found = _PARTS.findall(part.lower())
                plain.append((part, len(found)))
                words += found
            else:
                ids = self.slow.encode(part, add_special_tokens=False).ids
                self.known[part] = np.array(ids, np.uint32).astype("<u4").tobytes()
        if not words:
            return
        ranks = np.array(self.fast.encode_ordinary(_END.join(words) + _END), np.int64)
        ends = np.flatnonzero(self.is_end[ranks]) + 1
        ids = self.ids[ranks].astype("<u4")
        at = done = 0
        for part, n in plain:
            done += n
            stop = int(ends[done - 1]) if n else at
            self.known[part] = ids[at:stop].tobytes()
            at = stop

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text; none for null."""
        if not text:
            return b""
        parts = text.split() if _PLAIN.fullmatch(text) else [p for p in _GAPS.split(text) if p]
        ids = list(map(self.known.get, parts))
        if None in ids:
            new = [part for part, own in zip(parts, ids) if own is None]
            if len(self.known) + len(new) > self.room:
                self.known.clear()
                new = parts
            self._learn(dict.fromkeys(new))
            ids = map(self.known.__getitem__, parts)
        return b"".join(ids)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + n) for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Whole windows and the rest of every document's ids: one row per piece, ids as a CRC only.

    Each document ends with ``END_ID``, so a null or empty text is one piece of one id.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        encoder = _encoder(tokenizer)
        out: dict[str, list] = {n.split()[0]: [] for n in PIECES.split(", ")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = memoryview(encoder.encode(text) + end)
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out

    return map_batches(texts_of(docs), run, PIECES)


@dataclass(frozen=True)
class Pattern:
    """``copies`` sequences, each of the same piece lengths in this order."""

    lengths: tuple[int, ...]
    copies: int


def combinations(have: np.ndarray, window: int, popular: int = 6) -> list[dict[int, int]]:
    """Shallow fillings of a window: some copies of one length, and one or two others besides.

    Only lengths that occur are used. ``popular`` bounds the choices for the second of two others.
    """
    present = np.flatnonzero(have)
    common = [int(n) for n in present[np.argsort(-have[present], kind="stable")][:popular]]
    found = []
    for first in present.tolist():
        for k in range(1, min(8, window // first) + 1):
            rest = window - k * first
            if rest == 0:
                found.append({first: k})
                continue
            if have[rest]:
                found.append(_count([first] * k + [rest]))
            for second in common:
                if second < rest and have[rest - second]:
                    found.append(_count([first] * k + [second, rest - second]))
    return list({tuple(sorted(c.items())): c for c in found}.values())


def _count(lengths: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return out


def solve_counts(
    fillings: list[dict[int, int]], have: np.ndarray, rounds: int = 400
) -> np.ndarray:
    """Non-negative repeat counts that meet the histogram in the least squares sense.

    Accelerated projected gradient on the sparse system: a column is a filling, a row a length.
    """
    column = np.concatenate([[i] * len(f) for i, f in enumerate(fillings)]).astype(np.int64)
    row = np.concatenate([list(f) for f in fillings]).astype(np.int64)
    value = np.concatenate([list(f.values()) for f in fillings]).astype(np.float64)
    size = len(fillings)
    by_row = np.bincount(row, value, len(have)).max()
    step = 1.0 / (by_row * np.bincount(column, value, size).max())
    x = np.zeros(size)
    y, t = x, 1.0
    for _ in range(rounds):
        gap = np.bincount(row, value * y[column], len(have)) - have
        new = np.maximum(y - step * np.bincount(column, value * gap[row], size), 0)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x


def plan(have: np.ndarray, window: int = WINDOW) -> list[Pattern]:
    """Patterns that use every piece of the histogram ``have[length]`` exactly once."""
    left = have.astype(np.int64).copy()
    patterns = []
    if left[window]:
        patterns.append(Pattern((window,), int(left[window])))
        left[window] = 0
    fillings = combinations(left, window) if left.any() else []
    if fillings:
        counts = solve_counts(fillings, left.astype(np.float64))
        for i in np.argsort(-counts, kind="stable"):
            copies = min(int(counts[i] + 1e-9), *(left[n] // k for n, k in fillings[i].items()))
            if copies > 0:
                for n, k in fillings[i].items():
                    left[n] -= copies * k
                lengths = tuple(n for n, k in sorted(fillings[i].items()) for _ in range(k))
                patterns.append(Pattern(lengths, int(copies)))
    while left.any():
        patterns.append(_greedy(left, window))
    return patterns


def _greedy(left: np.ndarray, window: int) -> Pattern:
    """The longest pieces that still fit, as often as they last."""
    room, used, at = window, {}, window
    while room:
        fits = np.flatnonzero(left[: min(room, at) + 1])
        if not len(fits):
            break
        at = int(fits[-1])
        k = min(room // at, int(left[at]))
        used[at] = k
        room -= k * at
        at -= 1
    copies = min(int(left[n]) // k for n, k in used.items())
    for n, k in used.items():
        left[n] -= copies * k
    return Pattern(tuple(n for n, k in used.items() for _ in range(k)), copies)


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go: runs of ranks, sorted by length and first rank.

    In a run that begins at rank ``first``, rank ``r`` is piece ``(r - first) % width`` of its
    length in sequence ``base + (r - first) // width``; ``offsets`` of the run begin at ``at``.
    """

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    width: np.ndarray
    at: np.ndarray
    offsets: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        order = np.lexsort((rank, length))
        low = np.searchsorted(self.length, length[order], "left")
        high = np.searchsorted(self.length, length[order], "right")
        run = np.empty(len(order), np.int64)
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(np.arange(len(order)), edges):
            if len(part):
                a, b = low[part[0]], high[part[0]]
                own = np.searchsorted(self.first[a:b], rank[order[part]], "right")
                run[order[part]] = a + own - 1
        past = rank - self.first[run]
        return (
            self.base[run] + past // self.width[run],
            self.offsets[self.at[run] + past % self.width[run]],
        )


def places(patterns: list[Pattern], window: int = WINDOW) -> Places:
    next_rank = np.zeros(window + 1, np.int64)
    runs, offsets, base = [], [], 0
    for pattern in patterns:
        begins: dict[int, list[int]] = {}
        offset = 0
        for n in pattern.lengths:
            begins.setdefault(n, []).append(offset)
            offset += n
        for n, own in begins.items():
            runs.append((n, int(next_rank[n]), base, len(own), len(offsets)))
            offsets += own
            next_rank[n] += pattern.copies * len(own)
        base += pattern.copies
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Places(*columns, np.array(offsets, np.int64))


def ranked(pieces: DataFrame, groups: int = RANK_GROUPS) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0 without gaps.

    Numbered in ``groups`` separate groups per length, each set off by the sizes of those before
    it: a length that a third of all pieces have is spread over that many tasks.
    """
    salted = pieces.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "piece_no"), F.lit(groups))
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("piece_no")
    numbered = salted.withColumn("own", F.row_number().over(within) - 1)
    return numbered.join(sizes, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: PIECES and its ``sequence_id`` and ``offset``.

    Sequences are numbered from 0; the pieces of one follow each other from offset 0 without gaps
    and fill at most ``window`` ids. Repeated rows and rows without doc_id are documents of their
    own; a null text counts as empty; an empty table gives no pieces.
    """
    pieces = staged(
        cut_pieces(docs, tokenizer, window).withColumn("piece_no", F.monotonically_increasing_id()),
        "pieces",
    )
    have = np.zeros(window + 1, np.int64)
    # At most ``window`` rows whatever the data.
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():
        have[length] = n
    where = pieces.sparkSession.sparkContext.broadcast(places(plan(have, window), window))
    out = f"{PIECES}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = where.value.find(length, rank)
            columns = [batch.column(n.split()[0]) for n in PIECES.split(", ")]
            names = [n.split()[0] for n in out.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=names
            )

    return ranked(pieces).select(*(n.split()[0] for n in PIECES.split(", ")), "rank").mapInArrow(
        run, out
    )
