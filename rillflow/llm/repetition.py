"""Quality rules by repetition coverage: how much of a text lies inside what it says more than once.

Rolling hashes of the words, one per n-gram length, tell which windows of a text occur in it again;
the characters of their words are counted, each once. Lines are compared whole. A batch of texts is
done at once: words get numbers, windows of one text meet by sorting hash and text number, and each
repeat is checked word by word against the one before, so that no chance hit of the hash counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import map_batches, texts_of

# Words below which a text is too short, and share of its words, in per cent, that may lie in
# repeated windows of WINDOW words.
LEAST_WORDS = 50
WINDOW = 3
REPEATED = 50
SYMBOLS = b"#*$%&|<>"

# The largest share of a text's characters, in per cent, inside n-grams that it holds
# more than once, by words of the n-gram, and inside lines equal to an earlier one.
COVERED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES_COVERED = 20

# Characters of the texts that are done at once: bounds a task's memory, but for a longer text.
CHUNK = 1 << 22
# An odd factor of the rolling hash, whose inverse modulo 2^64 exists.
FACTOR = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit values of small numbers."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & _MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Hashes of all windows of a sequence of word numbers, of any length, from prefix sums."""

    def __init__(self, words: np.ndarray) -> None:
        terms = _mixed(words) * _powers(FACTOR, len(words))[: len(words)]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.inverse = _powers(pow(FACTOR, -1, 2**64), len(words))

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        """One hash per window of ``size`` words; equal windows have equal ones."""
        return (self.prefix[starts + size] - self.prefix[starts]) * self.inverse[starts]


def repeated_windows(
    words: np.ndarray, texts: np.ndarray, hashes: RollingHash, size: int
) -> np.ndarray:
    """Starts of the windows of ``size`` words that occur again in the same text.

    ``texts`` numbers the text of each word, rising.
    """
    starts = np.arange(max(len(words) - size + 1, 0))
    starts = starts[texts[starts] == texts[starts + size - 1]]
    keys = hashes.windows(starts, size) ^ _mixed(texts[starts])
    order = np.argsort(keys, kind="stable")
    # Almost all windows are alone; the rest is compared by its words.
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some, keys = starts[order[tied[: len(order)]]], keys[tied[: len(keys)]]
    if not len(some):
        return some
    rows = np.column_stack([texts[some], words[some[:, None] + np.arange(size)]])
    equal = (rows[1:] == rows[:-1]).all(1)
    if (equal != (keys[1:] == keys[:-1])).any():
        # Different windows share a hash: they are put in order by their words instead.
        by_words = np.lexsort(rows.T[::-1])
        some, rows = some[by_words], rows[by_words]
        equal = (rows[1:] == rows[:-1]).all(1)
    return some[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words at one of ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change)[:n_words] > 0


def _measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of some texts, as arrays with one entry per text."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    word_lists = [text.split() for text in texts]
    sizes = np.array([len(words) for words in word_lists])
    n_words = int(sizes.sum())
    words = np.fromiter(
        (numbers[word] for words in word_lists for word in words), np.int64, n_words
    )
    lengths = np.array([len(word.decode()) for word in numbers], np.int64)
    chars = lengths[words] if n_words else words
    of = np.repeat(np.arange(len(texts)), sizes)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, len(texts)).astype(np.int64)

    hashes = RollingHash(words)
    out = {"n_words": sizes, "word_chars": per_text(chars)}
    inside = covered(n_words, repeated_windows(words, of, hashes, WINDOW), WINDOW)
    out["n_repeat_words"] = per_text(inside)
    for size in COVERED:
        inside = covered(n_words, repeated_windows(words, of, hashes, size), size)
        out[f"chars_{size}"] = per_text(inside * chars)
    lines = [_repeated_lines(text) for text in texts]
    out["n_dup_lines"] = np.array([n for n, _ in lines], np.int64)
    out["line_chars"] = np.array([n for _, n in lines], np.int64)
    every = bytes(range(256))
    other = bytes(set(every) - set(SYMBOLS))
    out["n_symbols"] = np.array([len(text.translate(None, other)) for text in texts], np.int64)
    return out


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and the characters of their words."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines if len(lines) > 1 else []:
        if line in seen:
            n += 1
            chars += sum(len(word.decode()) for word in line.split())
        elif line.split():
            seen.add(line)
    return n, chars


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHUNK:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def measure(docs: DataFrame) -> DataFrame:
    """What the rules need to know of each text.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars`` and
    ``chars_5`` to ``chars_10``: characters of words inside n-grams of so many words that the text
    holds more than once, all occurrences included, each character once; ``line_chars`` are those of
    lines equal to an earlier one. Words are parted by ASCII white space.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars"]
    names += [f"chars_{size}" for size in COVERED]

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
        found = [_measured(some) for some in _chunks(texts)]
        columns = {name: np.concatenate([f[name] for f in found] or [[]]) for name in names}
        return {"doc_id": batch.column(0), **columns}

    schema = ", ".join(["doc_id long", *(f"{name} long" for name in names)])
    return map_batches(texts_of(docs), run, schema)


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every row of ``docs`` with ``base_failed`` and ``kept``.

    A text fails the base rules with fewer than 50 words, or with more than half of its words inside
    windows of three that it holds twice or more. Of the others those are kept whose repeats cover no
    more of their characters than the limits allow: COVERED for each length of n-gram, LINES_COVERED
    for lines. Null texts count as empty and fail; repeated rows and texts are judged by themselves;
    a text of any length is measured whole; an empty table gives an empty one. Other columns are not
    read, and doc_id may be null.
    """
    rows = measure(docs)
    failed = (rows["n_words"] < LEAST_WORDS) | (
        100 * rows["n_repeat_words"] > REPEATED * rows["n_words"]
    )
    within = 100 * rows["line_chars"] <= LINES_COVERED * rows["word_chars"]
    for size, most in COVERED.items():
        within &= 100 * rows[f"chars_{size}"] <= most * rows["word_chars"]
    return rows.select("*", failed.alias("base_failed"), (~failed & within).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; doc_ids must differ."""
    good = judge(docs).where("kept").select("doc_id")
    return docs.join(good, "doc_id", "left_semi").select(*docs.columns)
