"""Embeddings against brute force, the SQL of this part, and the pipeline by hand."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm.cases import no_docs, odd_docs
from llm.test_text_operators import covered, linked, plain_spans
from rillflow.llm import embedding_dedup, queries, simhash, suffix_dedup

SMALL = "/root/testdata/sf0.001"


def made_vectors():
    rng = np.random.default_rng(5)
    made = rng.standard_normal((400, 16))
    near = made[:150] + rng.standard_normal((150, 16)) * rng.uniform(0.02, 0.12, (150, 1))
    crowd = made[0] + rng.standard_normal((300, 16)) * 0.03
    return np.concatenate([made, near, crowd, made[:5] * 2])


def true_links(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T >= 0.95


@pytest.mark.parametrize("part, groups", [(1024, 0), (40, 1), (2, 2)])
def test_links_against_brute_force(spark, monkeypatch, part, groups):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    monkeypatch.setattr(embedding_dedup, "TILE", 100)
    every = made_vectors()
    assert embedding_dedup.plan(len(every) - 5, 0.95).groups == groups
    docs = spark.createDataFrame(
        [(i, v.tolist(), i) for i, v in enumerate(every)], "vec_id long, embedding array<double>, node int"
    )
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(docs).collect()}
    true = true_links(every).sum(1) - 1
    found = np.array([rows[i].n_links for i in range(len(every))])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() > 1000
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())
    assert all(rows[i].component_id <= i for i in rows)


def test_exact_links_are_all(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 4)
    monkeypatch.setattr(embedding_dedup, "TILE", 100)
    every = made_vectors()
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(docs, exact=True).collect()}
    true = true_links(every)
    group = linked_by(true)
    assert [rows[i].n_links for i in range(len(every))] == (true.sum(1) - 1).tolist()
    assert [rows[i].component_id for i in range(len(every))] == group


def linked_by(true):
    """The smallest member reachable from each."""
    group = list(range(len(true)))
    for start in range(len(true)):
        todo = [start] if group[start] == start else []
        while todo:
            for other in np.flatnonzero(true[todo.pop()]).tolist():
                if group[other] == other > start:
                    group[other] = start
                    todo.append(other)
    return group


def pairs_at(cosine, size, spread, n=2000):
    """Pairs of unit vectors at one cosine: spread evenly, about one direction, or in a crowd."""
    rng = np.random.default_rng([9, size])
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    first = unit(rng.standard_normal(size)[None, :] + spread * rng.standard_normal((n, size)))
    off = rng.standard_normal((n, size))
    off = unit(off - (off * first).sum(1, keepdims=True) * first)
    return first, cosine * first + np.sqrt(1 - cosine**2) * off


@pytest.mark.parametrize("n", [10**4, 10**6, 10**9])
@pytest.mark.parametrize("size, spread", [(64, 1e6), (64, 1.0), (64, 0.05), (16, 1e6), (768, 1.0)])
def test_recall_at_the_least_cosine_does_not_fall_with_the_rows(n, size, spread):
    how = embedding_dedup.plan(n, 0.95)
    assert how.groups >= 1 and how.tables <= embedding_dedup.TABLES
    half = embedding_dedup.WINDOW * embedding_dedup.distance(0.95)
    lines = embedding_dedup.counted_lines(size)
    for cosine, recall in ((0.95, 0.98), (0.96, 0.99)):
        first, second = pairs_at(cosine, size, spread)
        met = (embedding_dedup.cells_of(first, how) == embedding_dedup.cells_of(second, how)).any(1)
        counted = (np.abs(first @ lines - second @ lines) <= half).sum(1) >= how.least
        assert (met & counted).mean() >= recall


def test_windows_count_as_defined():
    rng = np.random.default_rng(3)
    a, b = np.round(rng.standard_normal((2, 70, embedding_dedup.LINES)), 1)
    seen = embedding_dedup.windows(a, b, 0.45)
    got = np.concatenate([embedding_dedup.collisions(seen, slice(i, i + 32)) for i in range(0, 70, 32)])
    assert (got == (np.abs(a[:, None] - b[None]) <= 0.45).sum(2)).all()


def test_a_low_cosine_lets_all_meet():
    assert embedding_dedup.plan(10**6, -0.5).groups == 0
    assert embedding_dedup.plan(0, 0.95) == embedding_dedup.plan(1000, 0.95)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]),
        (None, None), (10, [1e-300, 1e-300]), (11, [-1.0, -1.0]),
    ]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = embedding_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(vectors)
    links = Counter((r.vec_id, r.n_links, r.component_id) for r in rows)
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, 11, None)]
    joined = [(i, 4, 7) for i in (7, 8, 8, None, 10)]
    assert links == Counter(alone + joined)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    answer = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in answer.description]
    expected = Counter(answer.fetchall())
    got = queries.QUERIES[name](spark, folder).select(*columns).collect()
    assert Counter(tuple(r) for r in got) == expected


def test_embeddings_match_sql_when_cut(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 2)
    assert embedding_dedup.plan(400, 0.95).groups == 2
    test_queries_match_sql(spark, "op4_embedding_dedup")


def test_pipeline_by_hand(spark):
    """All but the languages, which only texts without letters fail, redone in plain Python."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = sorted((r.doc_id, r.text) for r in rows if any(c.isalpha() for c in r.text or ""))
    values = [int.from_bytes(simhash.fingerprint(t), "big") for _, t in texts]
    group = linked(values)
    texts = [pair for n, pair in enumerate(texts) if group[n] == n]
    gone = covered(texts, suffix_dedup.MIN_WORDS, later=True)
    slow = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    expected = Counter()
    for key, text in texts:
        spans = [{"start": w, "end": w + 1} for w in sorted(gone[key])]
        text = suffix_dedup.without(text, spans) if spans else text
        if not text:
            continue
        for start, end in sorted(((s, e) for _, s, e in plain_spans(text)), reverse=True):
            kind = next(k for k, s, e in plain_spans(text) if (s, e) == (start, end))
            text = f"{text[:start]}<{kind}>{text[end:]}"
        ids = slow.encode(text, add_special_tokens=False).ids + [2]
        for start in range(0, len(ids), 4096):
            piece = np.array(ids[start : start + 4096], "<u4").tobytes()
            expected[key, start, len(piece) // 4, zlib.crc32(piece), len(ids)] += 1
    got = corpus_pipeline.run(spark, SMALL).collect()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(tuple(r[n] for n in names) for r in got) == expected


def test_stages_take_odd_and_no_documents(spark, tmp_path):
    for docs in (odd_docs(spark), no_docs(spark)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, docs, SMALL)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert done.columns == docs.columns
            path = str(tmp_path / f"{docs.count()}-{n}")
            done.write.parquet(path)
            docs = spark.read.schema(done.schema).parquet(path)


CLASHING = ["__id", "__none", "__hash", "__n", "__row", "__no", "__spans", "__lang", "__score", "__found",
            "row_no", "fp", "node", "a.b", "extra_0"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, f"text number {i} with some plain words", "en", "s", 9, *(i * 100 + k for k in range(15)))
            for i in range(8)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, fields + "".join(f", `{name}` int" for name in CLASHING))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns
        done.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        found = [tuple(row)[5:] for row in docs.collect()]
        assert found and set(found) <= {row[5:] for row in rows}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(found)
