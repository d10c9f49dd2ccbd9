"""Repetition coverage against plain windows, line by line and word by word."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from llm.cases import no_docs, odd_docs, odd_rows
from rillflow.llm import repetition


def inside(words, size):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = Counter(windows)
    return {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(size)}


def plain(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    again = [line for i, line in enumerate(lines) if line in lines[:i]]
    chars = sum(map(len, words))
    out = {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(again),
        "n_repeat_words": len(inside(words, 3)),
        "line_chars": sum(c not in " \t\n\v\f\r" for line in again for c in line),
    }
    for size in range(5, 11):
        out[f"chars_{size}"] = sum(len(words[i]) for i in inside(words, size))
    failed = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    good = all(100 * out[f"chars_{s}"] <= (20 - s) * chars for s in range(5, 11))
    good = good and 100 * out["line_chars"] <= 20 * chars
    return {**out, "base_failed": failed, "kept": not failed and good}


def random_texts(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "日本語", "#", "<b>", "a b", "x|y", "\x00"]
    for _ in range(n):
        parts = draw.choices(words, k=draw.choice([0, 5, 49, 50, 300]))
        for _ in range(draw.choice([0, 0, 1, 4])):
            start, size = draw.randrange(len(parts) + 1), draw.choice([3, 5, 10, 60])
            place = draw.randrange(len(parts) + 1)
            parts[place:place] = parts[start : start + size]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", "\n", "\r\n", " \n"]) for w in parts)
        if draw.random() < 0.3:
            lines = text.split("\n")
            text = "\n".join(lines + draw.choices(lines, k=draw.choice([1, 5])))
        yield text


def judged(docs):
    rows = repetition.judge(docs).collect()
    return Counter((r.doc_id, *sorted(r.asDict().items())) for r in rows)


def expected(rows):
    return Counter((i, *sorted({"doc_id": i, **plain(t)}.items())) for i, t in rows)


def test_measures_equal_plain_windows(spark, monkeypatch):
    rows = list(enumerate(random_texts(4, 400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = expected(rows)
    verdicts = Counter((dict(k[1:])["base_failed"], dict(k[1:])["kept"]) for k in found)
    assert min(verdicts[pair] for pair in ((True, False), (False, False), (False, True))) > 20
    assert judged(docs) == found


def test_odd_documents(spark):
    assert judged(odd_docs(spark)) == expected([(r[0], r[1]) for r in odd_rows()])
    assert judged(no_docs(spark)) == Counter()
    kept = repetition.keep_good(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {8, 9}


def test_repeats_stay_within_their_text():
    texts = [b"a b c d e f", b"a b c d e f a b", b"b c"]
    found = repetition._measured(texts)
    assert found["n_repeat_words"].tolist() == [0, 0, 0]
    assert found["n_words"].tolist() == [6, 8, 2]


@pytest.mark.parametrize("size", [1, 3, 10])
def test_rolling_hashes_do_not_depend_on_the_place(size):
    words = np.random.default_rng(1).integers(0, 50, 300)
    twice = np.concatenate([words, words])
    hashes = repetition.RollingHash(twice).windows(np.arange(600 - size + 1), size)
    assert (hashes[: 300 - size] == hashes[300 : 600 - size]).all()
    assert len(np.unique(hashes)) == len(np.unique(np.lib.stride_tricks.sliding_window_view(twice, size), axis=0))


def test_chance_hits_do_not_count(monkeypatch):
    """With a hash of two values all windows meet, and only equal ones count."""
    words = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5, 6, 1, 2, 3])
    texts = np.repeat([0, 1], [10, 3])

    class Poor(repetition.RollingHash):
        def windows(self, starts, size):
            return starts.astype(np.uint64) % np.uint64(2)

    monkeypatch.setattr(repetition, "_mixed", lambda numbers: np.zeros(len(numbers), np.uint64))
    found = repetition.repeated_windows(words, texts, Poor(words), 3)
    assert sorted(found) == [0, 4]
