"""Whitened embeddings: rows projected on the leading components of the covariance of all of them.

The rows are spread over the tasks, the covariance is not: its size follows from the number of
dimensions alone. Tasks centre their vectors and add up products; the driver gets one matrix of
dimensions squared, turns it into tridiagonal form by Householder reflections, finds the largest
eigenvalues by bisection on Sturm counts and their vectors by inverse iteration, and sends the few
components back to all tasks. Entries are whole numbers, so sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_batches, prepare, staged, typed

COMPONENTS = 4
# Entries are multiples of one part in so many.
SCALE = 256
# Eigenvalues closer than this share of the matrix's norm are one cluster, whose vectors are made
# orthogonal to each other.
CLUSTER = 1e-3
# Smaller eigenvalues, as a share of the trace, are rounding errors: such a direction holds nothing.
LEAST_SHARE = 1e-11
LONG = 2**63


def scaled(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: whole numbers ``floor(256 c)``, for vectors without null or non-finite entries.

    An entry too large for a long counts as non-finite.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        vectors = batch.column(1)
        lengths = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
        entries = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        floors = np.floor(entries * SCALE)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(floors) < float(LONG)))])
        ends = np.cumsum(lengths)
        kept = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
        offsets = np.concatenate([[0], np.cumsum(lengths[kept])])
        x = floors[np.repeat(kept, lengths)].astype(np.int64)
        return {
            "vec_id": batch.column(0).filter(pa.array(kept)),
            "x": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)),
        }

    return map_batches(rows.select("vec_id", "embedding"), run, "vec_id long, x array<long>")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _summed(
    fit: DataFrame, size: int, values: Callable[[np.ndarray], np.ndarray], dimensions: int
) -> np.ndarray:
    """Sum over all vectors of the ``size`` numbers that ``values`` adds up for a batch of them.

    Each task adds up its own before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += values(_matrix(batch.column(0), dimensions))
        columns = [pa.array(np.arange(size)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "total"])

    schema = "at long, total double"
    partial = fit.select("x").mapInArrow(typed(run, schema), schema)
    out = np.zeros(size)
    for row in partial.groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[row["at"]] = row["total"]
    return out


def sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            n += len(x)
            # In two halves, which a task's rows cannot make overflow.
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        at = np.arange(dimensions)
        columns = [at, high, low, np.full(dimensions, n)]
        names = ["at", "high", "low", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    schema = "at long, high long, low long, n long"
    partial = fit.select("x").mapInArrow(typed(run, schema), schema)
    exact = [F.sum(F.col(name).cast("decimal(20,0)")).alias(name) for name in ("high", "low", "n")]
    found = partial.groupBy("at").agg(*exact).orderBy("at").collect()
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - S/n`` to double precision: the whole part of the mean is taken off exactly."""
    whole = [s // n for s in total]
    rest = np.array([(s % n) / n for s in total])
    small = max(map(abs, whole), default=0) < LONG // 4 and bool((np.abs(x) < LONG // 4).all())
    differences = x - np.array(whole, np.int64) if small else x.astype(object) - np.array(whole, object)
    return differences.astype(np.float64) - rest


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the ``n`` vectors with the divisor ``n``, centred before multiplying."""
    d = len(total)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, total)
        return (z.T @ z)[upper]

    out = np.zeros((d, d))
    out[upper] = _summed(fit, len(upper[0]), products, d) / n
    return out + np.triu(out, 1).T


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors ``v`` of ``A = H1 H2 ... T ... H2 H1``."""
    a = matrix.copy()
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        v = np.zeros(d)
        v[k + 1 :] = a[k + 1 :, k]
        v[k + 1] += np.copysign(np.linalg.norm(v), v[k + 1])
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflectors.append(v)
        # H A H with H = I - 2 v v'
        p = a @ v
        w = 2 * (p - (v @ p) * v)
        a -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of ``values``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((off**2).max(initial=0)))
    pivot = diagonal[0] - values
    below = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - values - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each by bisection until no double lies between."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    high += np.spacing(np.abs(high)) * 4
    wanted = d - 1 - np.arange(count)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Solution of ``(T - value) x = right`` by elimination with row exchanges."""
    d = len(diagonal)
    least = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    # Rows of the upper triangle hold three entries.
    one, two, three = diagonal - value, np.append(off, 0.0), np.zeros(d)
    x = right.copy()
    for i in range(d - 1):
        below = np.array([off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < d else 0.0])
        here = np.array([one[i], two[i], three[i]])
        if abs(below[0]) > abs(here[0]):
            below, here = here, below
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(here[0]) < least:
            here[0] = least
        factor = below[0] / here[0]
        one[i], two[i], three[i] = here
        one[i + 1], two[i + 1] = below[1] - factor * here[1], below[2] - factor * here[2]
        x[i + 1] -= factor * x[i]
    if abs(one[-1]) < least:
        one[-1] = least
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            x[i] -= two[i] * x[i + 1]
        if i + 2 < d:
            x[i] -= three[i] * x[i + 2]
        x[i] /= one[i]
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the falling ``values``, as rows, by inverse iteration.

    Vectors of one cluster are made orthogonal to each other after every step.
    """
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    start = np.random.default_rng(d)
    out = np.zeros((len(values), d))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        x = start.standard_normal(d)
        for _ in range(5):
            x = _solve(diagonal, off, value, x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[first:k].T @ (out[first:k] @ x)
            x /= np.linalg.norm(x)
        out[k] = x
    return out


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows.

    Only those that hold some of the trace; the largest entry of a vector is positive.
    """
    trace = float(np.trace(matrix))
    if not trace > 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    # Powers of two change no digit, and keep squares in range.
    unit = 2.0 ** np.floor(np.log2(trace))
    diagonal, off, reflectors = tridiagonal(matrix / unit)
    values = leading_values(diagonal, off, min(count, len(matrix)))
    values = values[values > LEAST_SHARE * trace / unit]
    rows = vectors_of(diagonal, off, values)
    for v in reversed(reflectors):
        rows -= 2 * np.outer(rows @ v, v)
    heads = rows[np.arange(len(rows)), np.abs(rows).argmax(1)]
    return values * unit, rows * np.sign(heads)[:, None]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S) ** 2``, exactly; null if it is no long."""
    most = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, total), default=0)
    if most**2 * max(len(total), 1) < LONG:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    found = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1)
    return [value if value < LONG else None for value in found]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    One row per vector and component. The fit is over the ``n`` different vectors: repeated ones
    count once there, but each row is whitened. Rows with a null vector, or one that holds a null or
    a non-finite entry, are left out, as are those with another number of dimensions than most
    vectors have (of equal numbers the larger), which no common component fits. Components of the
    covariance that hold nothing are left out: with one vector only, or none, the result is empty.
    Eigenvalues that tie have any orthogonal vectors of theirs. ``deviation`` is null where it is no
    long. Other columns are not read; a vec_id may be null or repeated.
    """
    spark = rows.sparkSession
    prepare(spark)
    x = staged(scaled(rows), "whitening-x")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    x = x.where(F.size("x") == d)
    fit = staged(x.select("x").distinct(), "whitening-fit")
    n, total = sums(fit, d)
    matrix = covariance(fit, n, total)
    values, vectors = leading_components(matrix, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((vectors / np.sqrt(values)[:, None], total))

    def project(batch: np.ndarray) -> np.ndarray:
        projection, sums_ = sent.value
        return _centred(batch, n, sums_) @ projection.T

    means = _summed(fit, k, lambda batch: project(batch).sum(0), d) / n

    def products(batch: np.ndarray) -> np.ndarray:
        w = project(batch) - means
        return (w.T @ w).ravel()

    identity = _summed(fit, k * k, products, d).reshape(k, k) / n
    error = float(np.abs(identity - np.eye(k)).max())
    explained = values / np.trace(matrix)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        vectors_ = _matrix(batch.column(1), d)
        m = len(vectors_)
        spread = deviations(vectors_, n, sent.value[1])
        return {
            "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
            "component": np.tile(np.arange(1, k + 1), m),
            "n": np.full(m * k, n),
            "deviation": pa.array([v for v in spread for _ in range(k)], pa.int64()),
            "whitened": project(vectors_).ravel(),
            "explained": np.tile(explained, m),
            "identity_error": np.full(m * k, error),
        }

    return map_batches(x, run, schema)
