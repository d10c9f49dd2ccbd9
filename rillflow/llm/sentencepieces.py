"""Offset-preserving SentencePiece encoding and decoding of BPE models with byte fallback.

Normalisation walks the text once: at each place the longest prefix known to the model's compiled
character map is replaced, any other character stays, and white space becomes the space symbol.
Every byte of the result remembers the original byte it came from, so that each piece is projected
to a span of the original text: ids, spans and decoded texts all come from this one way. Merges never cross the start of a word, since no piece holds a space
symbol after another character; words are therefore encoded one by one and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from rillflow.llm.common import map_batches, texts_of

SPACE = "▁"
# Letters that the quick way knows besides ASCII: at most 30, one spare control byte each.
ACCENTED = "äöüßéèêëçñáíóúàâîïôûùÄÖÜÉÈÊÇÑ"
MARK = "\x7f"
# Words a Python worker remembers.
CACHE_WORDS = 400_000
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """The compiled character map: a double-array trie over UTF-8, then the replacements.

    The blob holds the trie's size, its 32-bit units and zero-ended replacement strings. A unit
    carries a label in its low byte, a flag at bit 8 that it has a value, and an offset to its
    children; a unit with the top bit set is a value.
    """

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of ``text[at:]`` and its replacement; 0 if none."""
        best, value, node = 0, b"", 0
        if not self.units:
            return best, value
        node ^= _offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                best, value = i - at + 1, self.texts[start : self.texts.index(b"\0", start)]
        return best, value


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceEncoder:
    """Ids, original byte spans and decoded text, as a BPE model file defines them."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        self.charmap = CharMap(rules.precompiled_charsmap)
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.squeeze = rules.remove_extra_whitespaces
        pieces = list(model.pieces)
        self.names = [p.piece for p in pieces]
        self.kinds = [p.type for p in pieces]
        self.id_of = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.score = [p.score for p in pieces]
        self.byte_id = {
            int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE
        }
        odd = [k for k in set(self.kinds) if k in (USER, UNUSED)]
        crossing = [n for n in self.id_of if SPACE in n.lstrip(SPACE)]
        if odd or crossing or len(self.byte_id) != 256 or not rules.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and space-led pieces are known")
        self.line_apart = not any("\n" in n for n in self.id_of)
        self.room = cache_words
        # Ids of words seen, four bytes each.
        self.known: dict[str, bytes] = {}
        self.raw = [self._raw(i) for i in range(len(pieces))]
        self.id_texts = [str(i) for i in range(len(pieces))]
        sizes = [1 if k == BYTE else len(n.encode()) for n, k in zip(self.names, self.kinds)]
        self.sizes = np.array(sizes, np.int64)
        self._fast_merges()

    def _fast_merges(self) -> None:
        """Merge ranks of pieces of common characters, each written as one byte."""
        code = {c: c for c in map(chr, range(0x20, ord(MARK))) if c in self.id_of}
        spare = [SPACE, *(c for c in ACCENTED if c in self.id_of)]
        code |= {c: chr(n) for n, c in enumerate(spare, 1)}
        order = sorted(self.id_of, key=lambda n: -self.score[self.id_of[n]])
        merged = [n for n in order if len(n) > 1 and all(c in code for c in n)]
        ranks = {bytes([b]): b for b in range(256)}
        ids = [0] * 256
        for char, own in code.items():
            ids[ord(own)] = self.id_of[char]
        for name in merged:
            ranks["".join(code[c] for c in name).encode()] = len(ids)
            ids.append(self.id_of[name])
        self.fast_ids = np.array(ids, "<u4")
        # A mark between words comes out as a token of its own.
        self.fast = tiktoken.Encoding(
            "pieces", pat_str=f"[^{MARK}]+|{MARK}", mergeable_ranks=ranks, special_tokens={}
        )
        self.fast_code = str.maketrans({c: own for c, own in code.items() if c != own})
        self.is_fast = re.compile(f"[{re.escape(''.join(code))}]+")

    def _merge(self, word: str) -> list[int]:
        """Best-scored merges first, the leftmost of equals, as ids; unknown characters as bytes."""
        text: list[str | None] = list(word)
        after = list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(text):
                whole = text[left] + text[right]
                if whole in self.id_of:
                    heapq.heappush(heap, (-self.score[self.id_of[whole]], left, whole))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, left, whole = heapq.heappop(heap)
            right = after[left] if text[left] is not None else len(text)
            if right >= len(text) or text[left] + text[right] != whole:
                continue
            text[left], text[right] = whole, None
            after[left] = after[right]
            if after[left] < len(text):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        ids: list[int] = []
        for part in text:
            if part is not None and part in self.id_of:
                ids.append(self.id_of[part])
            elif part is not None:
                ids += [self.byte_id[b] for b in part.encode()]
        return ids

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words: those of common characters in one call, others one by one."""
        quick = [word for word in words if self.is_fast.fullmatch(word)]
        ranks = np.array(self.fast.encode_ordinary(MARK.join(quick).translate(self.fast_code)), np.int64)
        merged = self.fast_ids[ranks].tobytes()
        ends = np.append(np.flatnonzero(ranks == ord(MARK)), len(ranks)).tolist()
        start = 0
        for word, end in zip(quick, ends):
            self.known[word] = merged[4 * start : 4 * end]
            start = end + 1
        for word in words:
            if word not in self.known:
                self.known[word] = np.array(self._merge(word), "<u4").tobytes()

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte."""
        raw, sign = text.encode(), SPACE.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.charmap.units and not self.squeeze:
            grown = np.ones(len(raw) + 1, np.int64)
            grown[:-1][np.frombuffer(raw, np.uint8) == 0x20] = len(sign)
            grown[0] += len(self.prefix.encode())
            return self.prefix + text.replace(" ", SPACE), np.repeat(np.arange(len(raw) + 1), grown)
        parts, at = [], 0
        while at < len(raw):
            size, value = self.charmap.longest(raw, at)
            if not size:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                value = raw[at : at + size]
            parts.append((value, at))
            at += size
        if self.squeeze:
            head = next((i for i, (value, _) in enumerate(parts) if value != b" "), len(parts))
            parts = parts[head:]
            if not parts:
                return "", np.zeros(1, np.int64)
        out = bytearray(self.prefix.encode())
        source = [parts[0][1]] * len(out)
        end, after_space = len(raw), self.squeeze
        for value, start in parts:
            if after_space:
                value = value.lstrip(b" ")
            if value:
                after_space = self.squeeze and value.endswith(b" ")
            value = value.replace(b" ", sign)
            out += value
            source += [start] * len(value)
        while self.squeeze and out.endswith(sign):
            del out[-len(sign) :]
            end = source[len(out)]
            del source[len(out) :]
        return out.decode(), np.array([*source, end], np.int64)

    def _words(self, normal: str) -> list[str]:
        """Parts of a normalised text that merges never cross."""
        if self.line_apart:
            return re.findall(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", normal)
        return re.findall(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal)

    def _ids(self, normal: str) -> np.ndarray:
        words = self._words(normal)
        found = list(map(self.known.get, words))
        if None in found:
            new = [word for word, ids in zip(words, found) if ids is None]
            if len(self.known) + len(new) > self.room:
                self.known.clear()
                new = words
            self._learn(list(dict.fromkeys(new)))
            found = map(self.known.__getitem__, words)
        return np.frombuffer(b"".join(found), "<u4")

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Ids, and the original byte span ``[start, end)`` of each: one row per id."""
        normal, source = self.normalize(text or "")
        ids = self._ids(normal)
        edges = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=edges[1:])
        edges = source[edges]
        return ids.tolist(), np.stack([edges[:-1], edges[1:]], 1)

    def _raw(self, i: int) -> bytes:
        """Bytes that an id adds to the decoded text, wherever it stands."""
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        return self.names[i].replace(SPACE, " ").encode()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: byte pieces joined to UTF-8, the added first space taken off.

        Models that squeeze white space also lose single spaces in front of the first other piece.
        """
        ids = list(ids)
        out = b"".join(map(self.raw.__getitem__, ids))
        lead = 0
        for i in ids if self.prefix or self.squeeze else ():
            if self.kinds[i] != CONTROL:
                lead += self.kinds[i] == NORMAL and self.raw[i].startswith(b" ")
                if not self.squeeze or self.raw[i] != b" ":
                    break
        return _lenient(out[lead:])

    def digest(self, text: str | None) -> tuple[int, str, str, int, str]:
        """Number of ids, SHA-256 of ids and decoded ids, end of the last span, SHA-256 of spans."""
        ids, spans = self.encode(text)
        return (
            len(ids),
            _sha(",".join(map(self.id_texts.__getitem__, ids)).encode()),
            _sha(self.decode(ids).encode()),
            int(spans[-1, 1]) if len(spans) else 0,
            _sha(spans.astype("<i8").tobytes()),
        )


def _sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def _lenient(raw: bytes) -> str:
    """UTF-8 text; each byte that fits no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, starts, ends``: pieces of each text and the original bytes of each piece.

    A null text counts as empty and has no pieces; every row gives one row.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [_encoder(model).encode(t) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "ids": [ids for ids, _ in found],
            "starts": [spans[:, 0].tolist() for _, spans in found],
            "ends": [spans[:, 1].tolist() for _, spans in found],
        }

    schema = "doc_id long, ids array<int>, starts array<long>, ends array<long>"
    return map_batches(texts_of(docs), run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [_encoder(model).decode(ids or []) for ids in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "text": found}

    prepared = encoded.select("doc_id", "ids")
    return map_batches(prepared, run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, spans_sha256`` per row.

    ``covered_bytes`` is the end of the last piece's span in the original text; ``spans_sha256`` is
    taken over start and end of every piece as signed little-endian 64-bit numbers. A null text
    counts as empty; repeated rows give equal rows, an empty table none; texts of any length are
    encoded whole.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [_encoder(model).digest(t) for t in batch.column(1).to_pylist()]
        names = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256")
        columns = dict(zip(names, zip(*found))) if found else dict.fromkeys(names, [])
        return {"doc_id": batch.column(0)} | columns

    schema = (
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, "
        "spans_sha256 string"
    )
    return map_batches(texts_of(docs), run, schema)
