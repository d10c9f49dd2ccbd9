"""Whitening against plain numpy and whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rillflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int"


def rows_of(vectors):
    return [(i, v, 0, "x", 9) for i, v in vectors]


def plain(vectors, count=4):
    """n, sums, eigenvalues, components and trace of the different whole-number vectors."""
    fit = np.array(sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors}))
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    values, columns = np.linalg.eigh(z.T @ z / n)
    return n, total, values[::-1][:count], columns[:, ::-1][:, :count], values.sum()


def check(rows, vectors):
    n, total, values, columns, trace = plain(vectors.values())
    assert len(rows) == len(vectors) * len(values)
    by = {(r.vec_id, r.component): r for r in rows}
    ratios = {k: [] for _, k in by}
    for (vec_id, k), r in by.items():
        x = [math.floor(256 * float(np.float32(c))) for c in vectors[vec_id]]
        assert r.n == n
        assert r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
        expected = (np.array(x) - total / n) @ columns[:, k - 1] / math.sqrt(values[k - 1])
        ratios[k].append((expected, r.whitened))
        assert r.explained == pytest.approx(values[k - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    for pairs in ratios.values():
        # One sign for all rows of a component.
        expected, got = np.array(pairs).T
        assert np.allclose(got * np.sign(expected @ got), expected, atol=1e-8)
    assert len({r.identity_error for r in rows}) == 1


def test_query_equals_numpy(spark):
    folder = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check(queries.op12_whitening(spark, folder).collect(), vectors)


def test_repeated_vectors_count_once(spark):
    draw = np.random.default_rng(3)
    spread = [8.0, 4.0, 2.0, 1.0, 0.5, 0.25]
    vectors = {i: (draw.standard_normal(6) * spread + 1000).tolist() for i in range(60)}
    copies = {i + 60: vectors[0] for i in range(200)}
    docs = spark.createDataFrame(rows_of({**vectors, **copies}.items()), SCHEMA).repartition(7)
    check(whitening.whiten(docs).collect(), {**vectors, **copies})


def test_odd_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [0.0, 1.0], 2: [1.0, 0.0], 3: [-1.0, -0.5], 4: [-0.0, 2.0]}
    odd = [(5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0] * 3),
           (11, [1e38, 0.0])]
    docs = spark.createDataFrame(rows_of([*good.items(), *odd]), SCHEMA)
    check(whitening.whiten(docs).collect(), good)
    with_ids = spark.createDataFrame(rows_of([(None, good[1]), (1, good[2]), (1, good[2])]), SCHEMA)
    found = [r.vec_id for r in whitening.whiten(with_ids).collect()]
    assert sorted(map(str, found)) == ["1", "1", "None"]


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, vectors):
    docs = spark.createDataFrame(rows_of(vectors), SCHEMA)
    found = whitening.whiten(docs)
    assert found.collect() == []
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]


def test_large_entries_are_exact(spark):
    vectors = {i: [float(2**20 + i), float(-(2**21) + i * i)] for i in range(9)}
    rows = spark.createDataFrame(rows_of(vectors.items()), SCHEMA)
    check(whitening.whiten(rows).collect(), vectors)
    x = np.array([[2**40, 0], [2**40 + 3, 1], [2**62, 7]])
    total = [int(v) for v in x.astype(object).sum(0)]
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    assert whitening.deviations(x, 3, total) == [e if e < 2**63 else None for e in exact]
    assert whitening.deviations(x[:2], 2, [2**41 + 3, 1]) == [10, 10]


def spectra():
    draw = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 40):
        m = draw.standard_normal((d + 2, d))
        yield m.T @ m
        q, _ = np.linalg.qr(draw.standard_normal((d, d)))
        yield q @ np.diag(np.repeat([5.0, 1.0], [min(d, 3), d - min(d, 3)])) @ q.T
        yield q @ np.diag(np.geomspace(1, 1e-9, d)) @ q.T * 1e12
        yield np.eye(d)
        yield np.diag(np.arange(d, 0.0, -1))


@pytest.mark.parametrize("matrix", list(spectra()), ids=lambda m: str(len(m)))
def test_leading_components(matrix):
    matrix = (matrix + matrix.T) / 2
    values, rows = whitening.leading_components(matrix, 4)
    exact = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert len(values) == min(4, len(matrix))
    assert np.allclose(values, exact, rtol=1e-13, atol=1e-14 * exact[0])
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-13
    assert np.abs(rows @ matrix - values[:, None] * rows).max() < 1e-13 * exact[0]


def test_sturm_counts_are_those_of_the_spectrum():
    draw = np.random.default_rng(8)
    diagonal, off = draw.standard_normal(20), draw.standard_normal(19)
    off[7] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    between = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    assert whitening.sturm_counts(diagonal, off, between).tolist() == list(range(21))
