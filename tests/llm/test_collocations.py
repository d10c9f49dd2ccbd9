"""Phrases against a count of every window, and the index against plain search."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from llm.cases import COLUMNS, no_docs, odd_docs
from rillflow.llm import collocations
from rillflow.llm.common import LARGE_ROWS, staged


def plain(rows, least, top):
    """The contract in plain Python: ``rows`` of (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            cuts = ((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            score, k = min(cuts)
            holders = [
                b for q, b in found.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= 80 * a for b in holders):
                continue
            sides = (sum(q[1:] == p for q in found), sum(q[:-1] == p for q in found))
            phrase = " ".join(p)
            kept.append((-score, -a, phrase.encode(), phrase, counts[p[:k]], counts[p[k:]], sides))
        kept.sort()
        for rank, (score, a, _, phrase, left, right, sides) in enumerate(kept[:top], 1):
            out.add((lang, rank, phrase, -a, left, right, n[lang], -score, *sides))
    return out


def got(docs, **options):
    return {tuple(row) for row in collocations.collocations(docs, **options).collect()}


def random_rows(seed, n, words):
    draw = random.Random(seed)
    stock = [f"w{i}" for i in range(words)] + ["É", "日本", "Upper", "a.b", "x\ty", " ", "-"]
    weights = [1 / (i + 1) for i in range(len(stock))]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "?!"]
    rows = []
    for _ in range(n):
        size = draw.choice([0, 1, 3, 20, 200])
        text = "".join(w + draw.choice(ends) for w in draw.choices(stock, weights, k=size))
        rows.append((draw.choice(["en", "de", None, "und"]), draw.choice([text, text, "", None])))
    return rows + [("en", "one two three four five six. " * 40)] * 3


@pytest.mark.parametrize("seed, shard_words, top", [(1, 1 << 21, 2000), (2, 50, 2000), (3, 700, 5)])
def test_phrases_equal_a_plain_count(spark, seed, shard_words, top):
    rows = random_rows(seed, 300, 12)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = plain(rows, 6, top)
    assert len(expected) >= 15
    assert got(docs, least=6, top=top, shard_words=shard_words) == expected


def test_phrases_of_odd_documents(spark):
    rows = [(r.lang, r.text) for r in odd_docs(spark).collect()]
    assert got(odd_docs(spark), least=2) == plain(rows, 2, 2000)
    assert got(no_docs(spark)) == set()
    blank = spark.createDataFrame([(1, None), (2, " . ,")], "doc_id long, text string")
    blank = blank.selectExpr("doc_id", "text", "string(null) as lang", "1 as words", "2 as shard")
    assert got(blank, least=1) == set()
    assert odd_docs(spark).columns == re.findall(r"(\w+) \w+(?:, |$)", COLUMNS)


def test_scores_beyond_64_bits(spark):
    count = 10**13
    rows = [("en", "a", 1, 3 * count), ("en", "b", 1, 2 * count), ("en", "a b", 2, count)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, n_words int, f long")
    row = collocations.weakest_cuts(phrases).first()
    assert tuple(row.cut) == (2_000_000 // 5, 1, 3 * count, 2 * count)


def plain_text(seed, size):
    draw = np.random.default_rng(seed)
    text = draw.integers(0, 6, size).astype(np.int32)
    text[0] = text[-1] = 0
    return text


@pytest.mark.parametrize("seed", range(5))
def test_suffixes_are_sorted_by_four_words(seed):
    text = plain_text(seed, 500)
    rows = collocations.suffix_rows(text)
    assert sorted(rows) == list(range(len(text)))

    def key(start):
        words = []
        for at in range(start, min(start + 4, len(text))):
            # Separators are told apart by their place.
            words.append((text[at], at if text[at] == 0 else 0))
            if text[at] == 0:
                break
        return words

    keys = [key(start) for start in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", range(5))
def test_both_directions_find_all_phrases(seed):
    text = plain_text(seed, 400)
    ahead = collocations.transform(collocations.last_words(text))
    reverse = collocations.transform(collocations.last_words(text[::-1].copy()))

    def windows(size):
        found = zip(*(text[i:].tolist() for i in range(size)))
        return Counter(w for w in found if all(w))

    def counted(phrases):
        assert (phrases.sizes > 0).all()
        return {tuple(w): s for w, s in zip(phrases.words.tolist(), phrases.sizes.tolist())}

    one = collocations.single_words(reverse.lasts)
    assert counted(one) == windows(1)
    two = collocations.right(reverse, one)
    assert counted(two) == counted(collocations.left(ahead, one)) == windows(2)
    three = collocations.left(ahead, two)
    assert counted(three) == windows(3)
    assert counted(collocations.right(reverse, three)) == windows(4)
    assert counted(collocations.left(ahead, collocations.right(reverse, two))) == windows(4)
    some = two.only(np.arange(0, len(two.sizes), 2))
    kept = set(counted(some))
    expected = {w: n for s in (3, 4) for w, n in windows(s).items()
                if all(w[i : i + 2] in kept for i in range(s - 1))}
    found = {}
    for phrases in collocations.longer(ahead, reverse, some):
        found |= counted(phrases)
    assert found == expected


def test_a_shard_takes_memory_by_its_words_only():
    # Nothing is rare: half a million different phrases of four words.
    text = np.random.default_rng(1).integers(1, 400, 1 << 20).astype(np.uint16)
    text[0] = text[-1] = 0

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / len(text)

    lasts, bytes_a_word = peak(lambda: collocations.last_words(text))
    assert bytes_a_word < 60
    ahead = collocations.transform(lasts)
    reverse = collocations.transform(collocations.last_words(text[::-1].copy()))
    pairs = collocations.right(reverse, collocations.single_words(reverse.lasts))
    found, bytes_a_word = peak(
        lambda: sum(len(some.sizes) for some in collocations.longer(ahead, reverse, pairs))
    )
    assert found > 1 << 20
    assert bytes_a_word < 60


@pytest.mark.parametrize("block", [1, 7, 100])
def test_phrases_are_extended_in_blocks(monkeypatch, block):
    text = plain_text(11, 300)
    ahead = collocations.transform(collocations.last_words(text))
    reverse = collocations.transform(collocations.last_words(text[::-1].copy()))
    one = collocations.single_words(reverse.lasts)
    pairs = collocations.right(reverse, one)

    def counted(found):
        rows = [(*w, s) for some in found for w, s in zip(some.words.tolist(), some.sizes.tolist())]
        assert len(rows) == len(set(rows))
        return sorted(rows)

    whole = counted([pairs]), counted(collocations.longer(ahead, reverse, pairs))
    monkeypatch.setattr(collocations, "BLOCK", block)
    parts = list(collocations.blocks(one))
    assert len(parts) > 1
    assert all(sum(part.sizes) <= block or len(part.sizes) == 1 for part in parts)
    assert counted(collocations.right(reverse, part) for part in parts) == whole[0]
    assert counted(collocations.longer(ahead, reverse, pairs)) == whole[1]


def test_large_rows_are_read_a_few_at_a_time(spark):
    draw = random.Random(3)
    rows = [(i, bytearray(draw.randbytes(3 << 20))) for i in range(8)]
    frame = spark.createDataFrame(rows, "n long, text binary").coalesce(1)
    (file,) = staged(frame, "large", LARGE_ROWS).inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 2


def test_shards_are_told_in_binaries(spark):
    rows = [(n % 5, n, -n << 40) for n in range(1000)]
    places = spark.createDataFrame(rows, "shard long, one long, two long").repartition(3)
    told = collocations._told(places, "one", "two").toArrow().combine_chunks()
    assert pa.types.is_binary(told.schema.field("kept").type.value_type)
    found = [
        (shard, *pair)
        for i, shard in enumerate(told.column("shard").to_pylist())
        for pair in collocations._kept(told.column("kept").chunk(0), i).tolist()
    ]
    assert sorted(found) == sorted(rows)


def test_a_shard_ends_with_its_vocabulary(spark):
    rows = [("en" if n % 3 else "de", f"a{n} b{n} a b.") for n in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = collocations.shards(docs, vocabulary=20).collect()
    assert max(len(row.words) for row in found) < 25 < len(rows)
    words = Counter()
    for row in found:
        words.update(dict(zip(row.words[1:], row.counts[1:])))
    assert words == Counter(w for _, text in rows for w in text.rstrip(".").split())
