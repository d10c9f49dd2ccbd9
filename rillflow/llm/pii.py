"""Personal data by fixed patterns and by bootstrapped context.

Emails, IP addresses, card and phone numbers that the fixed patterns find are the seeds. The words
around them are lexical patterns. Spark scores both in turn: a pattern is worth the share of its
instances that are known to be personal data, an instance what its trusted patterns make of it.
Candidates are strings that look like an identifier of a kind but fail its fixed pattern; those that
trusted patterns vouch for, or that are written like a known one elsewhere, become spans as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from rillflow.llm.common import keeps_columns, staged, texts_of

# Kinds in the order of the digests, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

# Strings that look like an identifier but need a trusted context.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9._-]+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])[0-9(][0-9().\x20-]{5,20}[0-9](?![0-9])"),
}
_WORD = re.compile(r"[^\W_]+|[^\w\s]")
# Characters of context on either side that patterns are made from.
CONTEXT = 48

# A pattern counts if it has met so many different known instances, and is trusted from such a
# share of known ones among all its instances; an instance is taken from such a score.
SUPPORT = 3
TRUST = 0.8
ACCEPT = 0.8

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the characters before an ``@`` back to the match before, and a domain."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = max(at + 1, end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the fixed patterns, leftmost and not overlapping, in code points."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(_below_256(part) for part in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def _below_256(digits: str) -> bool:
    kept = digits.lstrip("0")
    return len(kept) < 4 and int(kept or 0) <= 255


def candidates(text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """Strings shaped like a kind that touch no base span and no candidate of an earlier kind."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    taken = sorted(span for spans in base.values() for span in spans)
    out = []
    for kind, shape in _SHAPES.items():
        new = []
        at = 0
        for m in shape.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free = at == len(taken) or taken[at][0] >= end
            digits = len(_NO_DIGIT.sub("", m.group()))
            fits = kind not in ("phone", "card") or (7 <= digits <= 15 if kind == "phone" else True)
            if free and fits:
                new.append((start, end))
        out += [(kind, *span) for span in new]
        taken = _merged(taken + new)
    return out


def _merged(spans: list[Span]) -> list[Span]:
    """The union of spans, sorted."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: two words before, and one word on either side."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])[-2:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + CONTEXT])[:1]]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _instance(kind: str, text: str) -> int:
    """One number for all ways to write an identifier."""
    plain = text.lower() if kind in ("email", "ip") else _NO_DIGIT.sub("", text)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - 2**63


SPAN = "struct<kind: string, start: long, end: long, known: boolean, instance: long, patterns: array<string>>"
ROWS = f"row_no long, doc_id long, found array<{SPAN}>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its base spans (``known``) and candidates, with their patterns."""

    def spans(text: str) -> list[dict]:
        base = base_spans(text)
        places = [(kind, *span, True) for kind in KINDS for span in base[kind]]
        places += [(*place, False) for place in candidates(text, base)]
        return [
            {
                "kind": kind,
                "start": start,
                "end": end,
                "known": known,
                "instance": _instance(kind, text[start:end]),
                "patterns": patterns(text, start, end),
            }
            for kind, start, end, known in places
        ]

    found_type = to_arrow_type(StructType.fromDDL(ROWS)["found"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t) if t else [] for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_no", "doc_id", "found"])

    rows = texts_of(docs).select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    return rows.mapInArrow(run, ROWS)


def score_instances(
    rows: DataFrame,
    support: int = SUPPORT,
    trust: float = TRUST,
    accept: float = ACCEPT,
) -> DataFrame:
    """``instance, score`` of the candidates that known instances or trusted patterns vouch for.

    The graph has an edge per pattern and instance that were met together. Each round scores
    patterns by their instances, then instances by their trusted patterns: one minus the product of
    the patterns' doubts. Both are sums per key, taken per task before the shuffle; patterns join
    back as one row each, so a pattern that a third of all places share is split by the planner.

    Scores only rise. Rounds end when none rises, or when no pattern with an instance below
    ``accept`` could be trusted even if all scores above 0 were 1: which instances reach ``accept``
    is then final, though their scores might rise further.
    """
    places = rows.select(F.explode("found").alias("s")).select("s.*")
    edges = staged(
        places.select("kind", "instance", "known", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "instance", "pattern")
        .agg(F.max("known").alias("known")),
        "pii-edges",
    )
    seeds = places.groupBy("instance").agg(F.max("known").alias("known"))
    scores = seeds.select("instance", F.col("known").cast("double").alias("score"))
    scores = staged(scores, "pii-scores")
    while True:
        met = edges.join(scores, "instance")
        above = (F.col("score") > 0).cast("int")
        worth = met.groupBy("kind", "pattern").agg(
            F.avg("score").alias("trust"),
            F.sum((F.col("score") >= 0.5).cast("int")).alias("n"),
            F.avg(above).alias("most"),
            F.sum(above).alias("n_most"),
            F.min("score").alias("least"),
        )
        worth = worth.where((F.col("n_most") >= support) & (F.col("most") >= trust))
        worth = staged(worth, "pii-patterns")
        if worth.where(F.col("least") < accept).isEmpty():
            return scores
        trusted = worth.where((F.col("n") >= support) & (F.col("trust") >= trust))
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        told = edges.join(trusted.select("kind", "pattern", "trust"), ["kind", "pattern"])
        # Rounded, so that sums in another order are no rise and rounds come to an end.
        told = told.groupBy("instance").agg(F.round(1 - F.exp(doubt), 9).alias("told"))
        new = F.greatest("score", F.coalesce("told", F.lit(0.0)))
        rose = (new > F.col("score")).alias("rose")
        joined = scores.select("instance", "score").join(told, "instance", "left")
        scores = staged(joined.select("instance", new.alias("score"), rose), "pii-scores")
        rising = not scores.where("rose").isEmpty()
        scores = scores.select("instance", "score")
        if not rising:
            return scores


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``row_no, doc_id, found``: base spans and accepted candidates of each row of ``docs``.

    Spans are in code points, end exclusive, by kind in the order of KINDS, then by start. A null
    text counts as empty; repeated rows and rows without doc_id are documents of their own, though an
    identifier or a pattern met many times counts once. A string of several shapes is a candidate of
    the first in the order of KINDS only. Very long texts are searched whole; an empty table gives
    no rows.
    """
    rows = staged(scan(docs), "pii")
    guessed = rows.select("row_no", F.explode("found").alias("s")).where("not s.known")
    scores = score_instances(rows, accept=accept).where(F.col("score") >= accept)
    taken = guessed.join(scores, guessed["s.instance"] == scores["instance"])
    taken = taken.groupBy("row_no").agg(F.collect_list("s").alias("more"))
    base = F.filter("found", lambda s: s["known"])
    both = F.concat(base, F.coalesce("more", F.filter("found", lambda s: F.lit(False))))
    return rows.join(taken, "row_no", "left").select("row_no", "doc_id", both.alias("found"))


def _listed(spans: list[dict], known_only: bool) -> str:
    order = {kind: n for n, kind in enumerate(KINDS)}
    chosen = [s for s in spans if s["known"] or not known_only]
    chosen.sort(key=lambda s: (order[s["kind"]], s["start"], s["end"]))
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in chosen)


def digests(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans of ``find``: base counts per kind, base digest, all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long"
    schema += ", base_sha256 string, spans string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = [
                pa.array([sum(s["known"] and s["kind"] == kind for s in r) for r in rows], pa.int64())
                for kind in KINDS
            ]
            base = [hashlib.sha256(_listed(r, True).encode()).hexdigest() for r in rows]
            spans = [_listed(r, False) for r in rows]
            columns = [batch.column(0), *counts, pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select("doc_id", "found").mapInArrow(run, schema)


@keeps_columns
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; same rows and columns.

    Overlapping spans are replaced together, under the kind of the first.
    """
    names, at = docs.columns, docs.columns.index("text")
    marked = docs.withColumn("__row", F.monotonically_increasing_id())
    marked = staged(marked, "pii-docs")
    plain = marked.select(F.col("__row").alias("doc_id"), "text")
    spans = find(plain).where(F.size("found") > 0)
    spans = spans.select(F.col("doc_id").alias("__row"), F.col("found").alias("__found"))
    joined = marked.join(spans, "__row", "left").drop("__row")

    def cover(text: str, found: list[dict]) -> str:
        spans = sorted((s["start"], -s["end"], s["kind"]) for s in found)
        out, end = [], 0
        for start, stop, kind in spans:
            if start >= end:
                out += [text[end:start], f"<{kind}>"]
            end = max(end, -stop)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            found = columns.pop().to_pylist()
            texts = columns[at].to_pylist()
            new = [cover(t, f) if f else t for t, f in zip(texts, found)]
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
