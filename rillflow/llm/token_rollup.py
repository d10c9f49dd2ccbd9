"""Token counts kept up to date by signed deltas.

A batch of changes becomes additive totals by source, language and tokenizer version: an insert
adds a document and its tokens, a delete takes them off, a revision takes off the old count and adds
the new one. A batch is committed by writing its totals into a folder of the attempt's own; of a
batch's folders the newest that was written to its end counts. So a repeated commit changes nothing,
and one that is lost half-way, by its tasks or by the driver, leaves what was committed before.
Totals are the sum over all committed batches, or over a compacted snapshot and the batches after
it. Batches are numbered from 0 and may come in any order; a snapshot ends before the first number
still missing.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import map_batches, texts_of

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """``doc_id, source, lang`` and one ``tokens_<version>`` per tokenizer: one row per row.

    ``tokenizers`` gives the rank file of each version. A null text counts no tokens.
    """
    names = {version: f"tokens_{version}" for version in tokenizers}

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column(1).to_pylist()
        out = {"doc_id": batch.column(0), "source": batch.column(2), "lang": batch.column(3)}
        for version, path in tokenizers.items():
            encode = _encoding(path, pattern).encode_ordinary
            out[names[version]] = [len(encode(t)) if t else 0 for t in texts]
        return out

    counts = ", ".join(f"{n} long" for n in names.values())
    schema = f"doc_id long, source string, lang string, {counts}"
    return map_batches(texts_of(docs, "source", "lang"), run, schema)


def change(rows: DataFrame, tokenizer: Column, tokens: Column, sign: int) -> DataFrame:
    """``rows`` as signed deltas: ``sign`` 1 adds the documents and their tokens, -1 takes them off."""
    return rows.select(
        F.col("source"),
        F.col("lang"),
        tokenizer.alias("tokenizer"),
        F.lit(sign).cast("long").alias("documents"),
        (tokens * sign).cast("long").alias("tokens"),
    )


def rolled_up(deltas: DataFrame) -> DataFrame:
    """Deltas summed per key, as TOTALS; keys that come to nothing are left out.

    Null sources, languages and tokenizers are keys of their own, null sums count as 0. Summed per
    task before the shuffle, so a source with a third of all rows weighs no more than others.
    """
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in SUMS]
    return deltas.groupBy(*KEYS).agg(*sums).where("documents <> 0 or tokens <> 0")


class Ledger:
    """Totals under ``path``: folders ``batch-<number>-<attempt>`` and ``snapshot-<number>-<attempt>``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._hadoop(self.path).getFileSystem(configuration)

    def _attempts(self, kind: str) -> dict[int, list[int]]:
        """Attempts at each number, finished or not."""
        root, found = self._hadoop(self.path), {}
        for status in self._files.listStatus(root) if self._files.exists(root) else []:
            name, *numbers = status.getPath().getName().split("-")
            if name == kind:
                found.setdefault(int(numbers[0]), []).append(int(numbers[1]))
        return found

    def _done(self, kind: str) -> dict[int, str]:
        """For each number the folder of its newest attempt that was written to the end."""
        out = {}
        for number, attempts in self._attempts(kind).items():
            for attempt in sorted(attempts, reverse=True):
                folder = f"{self.path}/{kind}-{number}-{attempt}"
                if self._files.exists(self._hadoop(f"{folder}/_SUCCESS")):
                    out[number] = folder
                    break
        return out

    def _write(self, kind: str, number: int, sums: DataFrame) -> None:
        attempt = max(self._attempts(kind).get(number, []), default=-1) + 1
        sums.write.parquet(f"{self.path}/{kind}-{number}-{attempt}")

    def commit(self, batch_id: int, deltas: DataFrame) -> None:
        """Add a batch; the same batch again replaces itself. Batches that a snapshot holds stay out."""
        if batch_id < 0:
            raise ValueError("batches are numbered from 0")
        if batch_id > max(self._done("snapshot"), default=-1):
            self._write("batch", batch_id, rolled_up(deltas))

    def totals(self) -> DataFrame:
        """TOTALS over everything committed; empty if nothing is."""
        snapshots, batches = self._done("snapshot"), self._done("batch")
        last = max(snapshots, default=-1)
        held = [snapshots[last]] if snapshots else []
        return self._sum(held + [folder for n, folder in batches.items() if n > last])

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        return rolled_up(self.spark.read.schema(TOTALS).parquet(*folders))

    def compact(self) -> None:
        """Sum up the batches so far, up to the first that is missing and may still come.

        What the snapshot before has replaced goes now; what this one replaces stays for those who
        still read it, until the next one.
        """
        snapshots, batches = self._done("snapshot"), self._done("batch")
        before = last = max(snapshots, default=-1)
        while last + 1 in batches:
            last += 1
        if last > before:
            held = [snapshots[before]] if snapshots else []
            self._write("snapshot", last, self._sum(held + [batches[n] for n in range(before + 1, last + 1)]))
            self._release(before)

    def _release(self, replaced: int) -> None:
        """Remove batches up to a snapshot, and the snapshots before it."""
        for kind, end in (("batch", replaced + 1), ("snapshot", replaced)):
            for number, attempts in self._attempts(kind).items():
                for attempt in attempts if number < end else []:
                    self._files.delete(self._hadoop(f"{self.path}/{kind}-{number}-{attempt}"), True)
