"""Embedding near-duplicates by collision counting over one-dimensional projections.

Each vector is projected onto many random lines. On every line the vectors that meet are sorted, and
those in a window centred on a vector collide with it; near vectors collide on most lines, others on
few. Pairs with at least as many collisions as all but a small share of true pairs have are verified
by their cosine.

A window around a vector holds a good part of any line, so whole lines would give pairs without
number. Vectors therefore meet in cells: a cell is named by which of a few lines its vectors lie
furthest out on, and on which side, for several groups of lines; and there are several tables of
cells. Whether a pair shares a cell depends on its cosine alone, not on how many other vectors there
are or how they are spread, so the number of tables follows from the share of pairs to be found.
Exact copies are one vector with a weight, and a cell that stays large, as that of a crowd of near
copies does, is compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import arrow_schema, components, map_batches, prepare, staged

COSINE = 0.95
# Lines whose collisions are counted, and the share of pairs at the least cosine that their count
# must keep, and that the cells must bring together. The latter holds over all pairs; those of one
# crowd share their luck, so it is set high enough that hardly any crowd loses one in a hundred.
LINES = 24
RECALL = 0.995
MEETING = 0.999
# Half the window of a collision, in units of the distance of two vectors at the least cosine.
WINDOW = 1.5
# Most lines of a group, of which the furthest names a vector's part, and most tables of cells: with
# a cosine so low that more were needed there are fewer groups, and with none one cell for all.
GROUP = 64
TABLES = 64
# Vectors that share a cell when evenly spread, at most, and vectors of a tile.
PART = 1024
TILE = 2048
BLOCK = 512
SEED = 95
# Made pairs that tell how often a group of lines names the same part twice.
TRIALS = 100_000


@dataclass(frozen=True)
class Plan:
    """How vectors meet: groups of lines that name a cell, tables of cells, least collisions."""

    groups: int
    lines: int
    tables: int
    least: int


def distance(cosine: float) -> float:
    """Of two unit vectors."""
    return sqrt(max(0.0, 2 - 2 * cosine))


def least_collisions(recall: float = RECALL) -> int:
    """The largest count that ``recall`` of the pairs at the least cosine reach.

    Their projections differ by a normal variable, so each line is an independent trial.
    """
    p = erf(WINDOW / sqrt(2))
    tail = 0.0
    for count in range(LINES, -1, -1):
        tail += comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
        if tail >= recall:
            return count
    return 0


@cache
def agreement(cosine: float, lines: int) -> float:
    """How often two unit vectors at ``cosine`` lie furthest out on the same side of the same line.

    Their places on a random line are two normal variables with that correlation, whatever their
    size, so made pairs tell it; three standard errors are taken off.
    """
    made = np.random.default_rng([SEED, lines])
    first, other = made.standard_normal((2, TRIALS, lines))
    second = cosine * first + sqrt(max(0.0, 1 - cosine * cosine)) * other
    share = float((_furthest(first) == _furthest(second)).mean())
    return share - 3 * sqrt(share * (1 - share) / TRIALS)


def plan(n: int, cosine: float, exact: bool = False) -> Plan:
    """For ``n`` vectors: cells of PART if evenly spread, tables for MEETING of the pairs."""
    if exact:
        return Plan(0, 0, 1, 0)
    cells = max(1.0, n / PART)
    groups = ceil(log(cells) / log(2 * GROUP))
    while groups:
        lines = min(GROUP, ceil(cells ** (1 / groups) / 2))
        found = max(0.0, agreement(cosine, lines)) ** groups
        tables = ceil(log(1 - MEETING) / log(1 - found)) if 0 < found < 1 else TABLES + 1
        if tables <= TABLES:
            return Plan(groups, lines, tables, least_collisions())
        groups -= 1
    return Plan(0, 0, 1, least_collisions())


@cache
def counted_lines(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, LINES))


@cache
def naming_lines(size: int, how: Plan) -> np.ndarray:
    made = np.random.default_rng([SEED, size, how.groups])
    return made.standard_normal((size, how.tables * how.groups * how.lines))


def _furthest(places: np.ndarray) -> np.ndarray:
    """Along the last axis: the line furthest out, doubled, and one more on its lower side."""
    line = np.abs(places).argmax(-1)
    there = np.take_along_axis(places, line[..., None], -1)[..., 0]
    return 2 * line + (there < 0)


def cells_of(units: np.ndarray, how: Plan) -> np.ndarray:
    """Each unit vector's cell in each table."""
    if not how.groups:
        return np.zeros((len(units), how.tables), np.int64)
    places = units @ naming_lines(units.shape[1], how)
    parts = _furthest(places.reshape(len(units), how.tables, how.groups, how.lines))
    return parts @ (2 * how.lines) ** np.arange(how.groups, dtype=np.int64)


def _unit(vector: list[float | None] | None) -> bytes | None:
    """The unit vector's doubles; None where a vector has no direction."""
    if not vector or None in vector:
        return None
    out = np.array(vector, np.float64)
    top = np.abs(out).max()
    if not np.isfinite(top) or top == 0:
        return None
    out /= top
    return (out / np.linalg.norm(out)).tobytes()


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``row_no, vec_id, unit``: numbered rows with unit vectors, null where there is none."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        units = [_unit(v) for v in batch.column(2).to_pylist()]
        return {"row_no": batch.column(0), "vec_id": batch.column(1), "unit": units}

    numbered = vectors.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", "embedding")
    return map_batches(numbered, run, "row_no long, vec_id long, unit binary")


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _by_size(units: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by size of vector: the size, their places and their vectors."""
    sizes = np.array([len(u) // 8 for u in units.to_pylist()], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, _matrix(units.take(pa.array(rows)))


MEETINGS = "no long, size long, cell long, point long, weight long, cells array<long>, unit binary"


def meetings(points: DataFrame, how: Plan) -> DataFrame:
    """A row per vector and table ``no``: its cell there, and ``cells``, those in all tables."""
    schema = arrow_schema(MEETINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, matrix in _by_size(batch.column(2)):
                cells = cells_of(matrix, how)
                point, weight, unit = (batch.column(i).take(pa.array(rows)) for i in range(3))
                every = pa.array(cells.tolist(), pa.list_(pa.int64()))
                for no in range(how.tables):
                    same = [pa.array(np.full(len(rows), x)) for x in (no, size)]
                    columns = [*same, pa.array(cells[:, no]), point, weight, every, unit]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return points.select("point", "weight", "unit").mapInArrow(run, MEETINGS)


def tiled(rows: DataFrame) -> DataFrame:
    """Cells of more than TILE vectors as pairs of tiles: each vector meets every tile once."""
    key = ["no", "size", "cell"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    placed = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("point", "no"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    met = placed.select("*", other)
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


@dataclass(frozen=True)
class Windows:
    """Of each query on each line: where its window begins among the sorted others, and its length.

    ``rank`` is where the others stand on each line.
    """

    rank: np.ndarray
    start: np.ndarray
    length: np.ndarray


def windows(queries: np.ndarray, others: np.ndarray, half: float) -> Windows:
    """Sort ``others`` on every line and find the windows centred on ``queries``."""
    kind = np.uint16 if len(others) < 1 << 16 else np.uint32
    rank = np.empty((LINES, len(others)), kind)
    start = np.empty((LINES, len(queries)), kind)
    length = np.empty((LINES, len(queries)), kind)
    for line in range(LINES):
        order = np.argsort(others[:, line])
        rank[line, order] = np.arange(len(others), dtype=kind)
        values = others[order, line]
        start[line] = np.searchsorted(values, queries[:, line] - half, "left")
        length[line] = np.searchsorted(values, queries[:, line] + half, "right") - start[line]
    return Windows(rank, start, length)


def collisions(found: Windows, rows: slice) -> np.ndarray:
    """In how many windows of each of the queries ``rows`` each of the others stands."""
    start, length = found.start[:, rows], found.length[:, rows]
    count = np.zeros((start.shape[1], found.rank.shape[1]), np.uint8)
    for line in range(LINES):
        # Unsigned: a rank before the start of the window becomes a large number.
        count += found.rank[line][None, :] - start[line][:, None] < length[line][:, None]
    return count


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what others of the same task have not joined yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append((x, y))
    return kept


def link_pairs(met: DataFrame, cosine: float, how: Plan) -> DataFrame:
    """``a, b, n``: what each task found. With b null, ``n`` more links of a; else a link that joins.

    A pair is counted in one place only: in the first table in which it shares a cell.
    """
    # Rounding must not put a pair on the edge of a window outside it.
    half = WINDOW * distance(cosine) * (1 + 1e-9) + 1e-9

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        no, i, j = (int(group[name].iloc[0]) for name in ("no", "i", "j"))
        unit, own = _matrix(group["unit"]), group["own"].to_numpy()
        point, weight = group["point"].to_numpy(), group["weight"].to_numpy()
        cells = np.stack(group["cells"].to_numpy())
        place = unit @ counted_lines(unit.shape[1])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        seen = windows(place[left], place[right], half)
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), BLOCK):
            rows = slice(at, at + BLOCK)
            x, y = np.nonzero(collisions(seen, rows) >= how.least)
            x, y = left[rows][x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                here = (cells[a, :no] != cells[b, :no]).all(1)
                a, b = a[here], b[here]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                found.append(np.stack([a[near], b[near]]))
        a, b = np.concatenate(found, 1)
        links = np.bincount(a, weight[b], len(point)) + np.bincount(b, weight[a], len(point))
        some = np.flatnonzero(links)
        joins = _forest(point[a], point[b])
        return pd.DataFrame(
            {
                "a": np.concatenate([point[some], np.array([x for x, _ in joins], np.int64)]),
                "b": pd.array([None] * len(some) + [y for _, y in joins], "Int64"),
                "n": np.concatenate([links[some].astype(np.int64), np.zeros(len(joins), np.int64)]),
            }
        )

    key = ["no", "size", "cell", "i", "j"]
    columns = [*key, "own", "point", "weight", "cells", "unit"]
    return met.select(*columns).groupBy(*key).applyInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    At any number of vectors, however spread, at least MEETING times RECALL of the pairs right
    at ``cosine`` are found, and more of nearer ones; up to PART different vectors all meet. ``exact``
    lets all vectors meet, whatever the work, and verifies every pair.

    ``n_links`` counts the other rows found with at least ``cosine``, ``component_id`` is the
    smallest vec_id reachable over such links, the row's own included. A vector that is null,
    empty, zero or holds a null or a component that is not finite links with nothing, nor do
    vectors of different sizes. Repeated rows are vectors of their own that link. A row without
    vec_id takes part like others; a component without any id is null. ``kept`` is whether both
    ids are equal, two nulls included. Other columns are not read; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = staged(unit_vectors(vectors), "vectors")
    points = rows.where(F.col("unit").isNotNull()).groupBy("unit")
    points = points.agg(F.min("row_no").alias("point"), F.count("*").alias("weight"))
    points = staged(points, "points")
    how = plan(points.count(), cosine, exact)
    met = tiled(staged(meetings(points, how), "meetings"))
    found = staged(link_pairs(met, cosine, how), "pairs")
    joined = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    classes = points.join(joined, points["point"] == joined["node"], "left")
    classes = classes.join(counts, classes["point"] == counts["a"], "left").select(
        "unit",
        F.coalesce("component", "point").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    placed = staged(
        rows.join(classes, "unit", "left").select(
            "row_no",
            "vec_id",
            F.coalesce("component", "row_no").alias("component"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "classes",
    )
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "component").select(
        "vec_id",
        "n_links",
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
