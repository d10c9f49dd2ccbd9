"""SimHash near-duplicates by a generalised pigeonhole search.

Two fingerprints that differ in at most ``radius`` bits differ in at most ``t_i`` bits in one of
their parts, if the thresholds ``t_i`` of the parts add up to ``radius - parts + 1`` (a threshold of
-1 leaves a part out). Correlated bits go into the same part, so that parts tell different things;
how many parts there are, and for each fingerprint the cheapest thresholds, follow from estimated
candidate counts by dynamic programming. Each fingerprint probes the values within its thresholds
and the candidates are verified on all 64 bits. A fingerprint whose every choice is dear, because it
lies in a crowded spot, probes all fingerprints within ``radius`` instead, whose number is fixed: so
no crowd makes the work grow with its square, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import components, keeps_columns, map_batches, staged, texts_of

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
# Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Big-endian SimHash of the word shingles, repeats included; zero without words.

    A-Z is lower-cased and ASCII white space separates words. Fewer words than a shingle are one
    shingle. A bit is set if it is set in over half of the shingles' hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hash_of = xxhash.xxh64_digest
    digests = b"".join([hash_of(b" ".join(part), SEED) for part in parts])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = sum(
        np.unpackbits(rows[i : i + BLOCK], axis=1).sum(0, dtype=np.int64)
        for i in range(0, len(rows), BLOCK)
    )
    return np.packbits(ones * 2 > len(rows)).tobytes()


def text_hash() -> Column:
    """Tells apart rows of one doc_id; a null text counts as empty."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """``doc_id, fp``: one row per document; ``fp`` holds the 64 bits as a signed long.

    With ``hashed`` also ``text_hash``.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = b"".join(fingerprint(t, shingle) for t in batch.column(1).to_pylist())
        out = {"doc_id": batch.column(0), "fp": np.frombuffer(found, ">i8").astype(np.int64)}
        return out | ({"text_hash": batch.column(2)} if hashed else {})

    rows = texts_of(docs, *([text_hash().alias("text_hash")] if hashed else []))
    return map_batches(rows, run, "doc_id long, fp long" + (", text_hash string" if hashed else ""))


def bit_counts(points: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, over all distinct fingerprints: 64 x 64."""
    upper = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*upper, total[upper].astype(np.int64))], names=["i", "j", "c"]
        )

    rows = points.select("fp").mapInArrow(run, "i long, j long, c long")
    both = np.zeros((BITS, BITS))
    for i, j, c in rows.groupBy("i", "j").agg(F.sum("c")).collect():
        both[i, j] = both[j, i] = c
    return both


def bit_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated bits together."""
    p = both / max(n, 1)
    share = np.diag(p)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(p - np.outer(share, share)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for k in range(parts, 0, -1):
        size = -(-len(left) // k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _probes(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(costs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest thresholds per row of ``costs[row, part, t + 1]``, t from -1 to ``radius``.

    Dynamic programming over the parts and the sum of ``t + 1``, which must come to
    ``radius + 1``. Gives the thresholds per part and their cost.
    """
    rows, parts, _ = costs.shape
    total = radius + 1
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, rows, total + 1), np.int8)
    for part in range(parts):
        new = np.full_like(best, np.inf)
        for got in range(total + 1):
            for t in range(got + 1):
                cost = best[:, got - t] + costs[:, part, t]
                better = cost < new[:, got]
                new[better, got] = cost[better]
                choice[part, better, got] = t
        best = new
    thresholds = np.zeros((rows, parts), np.int8)
    left = np.full(rows, total)
    for part in reversed(range(parts)):
        thresholds[:, part] = choice[part, np.arange(rows), left]
        left -= thresholds[:, part]
    return thresholds - 1, best[:, total]


def _costs(exact: np.ndarray, widths: list[int], n: int, radius: int) -> np.ndarray:
    """Estimated probes and candidates per part and threshold; ``exact`` counts the own value."""
    out = np.zeros((len(exact), len(widths), radius + 2))
    for part, width in enumerate(widths):
        around = n / 2.0**width
        for t in range(radius + 1):
            probes = _probes(width, t)
            out[:, part, t + 1] = probes + exact[:, part] + (probes - 1) * around
    return out


def choose_parts(n: int, radius: int = RADIUS) -> int:
    """The number of parts with the lowest estimated cost for ``n`` evenly spread fingerprints."""

    def cost(parts: int) -> float:
        widths = [BITS // parts] * parts
        exact = np.full((1, parts), 1 + n / 2.0 ** widths[0])
        return allocate(_costs(exact, widths, n, radius), radius)[1][0]

    return min(range(2, radius + 3), key=cost)


def _part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for place, bit in enumerate(bits):
        out |= ((fp >> np.int64(bit)) & np.int64(1)) << np.int64(place)
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` set, the zero first."""
    found = [
        sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)
    ]
    return np.array(found, np.uint64).astype(np.int64)


def links(points: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """``a, b``: nodes of all fingerprints that differ in at most ``radius`` bits.

    ``points`` has one row ``fp, node`` per distinct fingerprint. Each pair is found from the
    smaller fingerprint, possibly several times.
    """
    n = points.count()
    parts = parts or choose_parts(n, radius)
    groups = bit_parts(bit_counts(points), n, parts)
    widths = [len(g) for g in groups]

    def split(batch: pa.RecordBatch) -> dict[str, object]:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        values = [_part_value(fp, g) for g in groups] + [fp]
        k = len(values)
        return {
            "part": np.repeat(np.arange(k), len(fp)),
            "value": np.concatenate(values),
            "fp": np.tile(fp, k),
            "node": pa.concat_arrays([batch.column(1)] * k),
        }

    index = staged(
        map_batches(points.select("fp", "node"), split, "part long, value long, fp long, node long"),
        "simhash-index",
    )
    crowds = index.where(F.col("part") < parts).groupBy("part", "value").agg(F.count("*").alias("n"))
    crowds = index.where(F.col("part") < parts).join(crowds, ["part", "value"])
    own = [F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)]
    queries = crowds.groupBy("fp").agg(F.max("node").alias("node"), *own)

    masks = [[_masks(w, t) for t in range(radius + 1)] for w in widths]
    everywhere = _masks(BITS, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            exact = np.stack(
                [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(parts)], 1
            )
            thresholds, cost = allocate(_costs(exact, widths, n, radius), radius)
            crowded = cost > len(everywhere)
            for part, bits in enumerate(groups):
                value = _part_value(fp, bits)
                for t in range(radius + 1):
                    chosen = ~crowded & (thresholds[:, part] == t)
                    yield from _probe_rows(part, value, masks[part][t], fp, node, chosen)
            yield from _probe_rows(parts, fp, everywhere, fp, node, crowded)

    probes = queries.select("fp", "node", *(f"n{i}" for i in range(parts)))
    probes = probes.mapInArrow(probe, "part long, value long, q long, a long")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    same = (probes.part == index.part) & (probes.value == index.value)
    found = probes.join(index, same & (F.col("q") < F.col("fp")) & near)
    return found.select("a", F.col("node").alias("b"))


def _probe_rows(
    part: int,
    value: np.ndarray,
    masks: np.ndarray,
    fp: np.ndarray,
    node: np.ndarray,
    chosen: np.ndarray,
    rows: int = 1 << 17,
) -> Iterator[pa.RecordBatch]:
    """Probes of the chosen fingerprints, a bounded number of rows at a time."""
    picked = np.flatnonzero(chosen)
    step = max(1, rows // len(masks))
    for i in range(0, len(picked), step):
        some = picked[i : i + step]
        probed = (value[some][:, None] ^ masks[None, :]).ravel()
        columns = [
            np.full(len(probed), part, np.int64),
            probed,
            np.repeat(fp[some], len(masks)),
            np.repeat(node[some], len(masks)),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["part", "value", "q", "a"]
        )


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, parts: int | None = None
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest doc_id that can be reached
    over links of at most ``radius`` differing bits, the document's own included. Null and empty
    texts have fingerprint zero and link like others. A row without doc_id links like others but
    adds no id; a group without any id has component null. Repeated rows each give a row. An empty
    table gives an empty one.
    """
    prints = staged(fingerprints(docs, shingle), "simhash")
    return _grouped(prints, radius, parts).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _grouped(prints: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """``prints`` with their ``link_group`` and its smallest doc_id as ``component``."""
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-groups")
    if points.isEmpty():
        classes = points.select("fp", F.col("fp").alias("link_group"), F.col("id").alias("component"))
    else:
        found = components(links(points.select("fp", F.col("fp").alias("node")), radius, parts))
        classes = points.join(found, points["fp"] == found["node"], "left").select(
            "fp", "id", F.coalesce("component", "fp").alias("link_group")
        )
        least = classes.groupBy("link_group").agg(F.min("id").alias("component"))
        classes = classes.join(least, "link_group").select("fp", "link_group", "component")
    return prints.join(classes, "fp")


@keeps_columns
def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Of each group one row: the one with the smallest doc_id. Columns are unchanged.

    Rows without doc_id go if a row with one is in their group. Of several rows with the smallest
    doc_id, or of a group without any, the one with the smallest hash of its text stays, of exact
    copies the first by their other columns. Rows of other groups with the same doc_id are not
    touched.
    """
    prints = staged(fingerprints(docs, shingle, hashed=True), "simhash")
    return one_of_each(docs, _grouped(prints, radius))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row of ``docs`` that stays of each group, as ``keep_one`` says.

    ``grouped`` has ``doc_id, text_hash, link_group, component`` for every row of ``docs``.
    """
    heads = grouped.where("doc_id <=> component")
    heads = heads.groupBy("link_group", "component").agg(F.min("text_hash").alias("own"))
    # The join and the window share one shuffle: plain equality of the same columns.
    key = ["__id", "__none", "__hash"]

    def keyed(rows: DataFrame, name: str, hashed: Column) -> DataFrame:
        number = F.coalesce(name, F.lit(0)).alias("__id")
        return rows.select("*", number, F.col(name).isNull().alias("__none"), hashed.alias("__hash"))

    heads = keyed(heads, "component", F.col("own")).select(*key)
    others = F.to_json(F.struct(F.lit(0), *(c for c in docs.columns if c != "text")))
    first = Window.partitionBy(*key).orderBy(others)
    one = keyed(docs, "doc_id", text_hash()).join(heads, key)
    one = one.withColumn("__n", F.row_number().over(first))
    return one.where(F.col("__n") == 1).select(*docs.columns)
