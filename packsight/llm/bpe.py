"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged, so a text may be cut
between the two bytes. The fragments between such cuts are encoded independently of each other (each
distinct fragment once per worker, its ids being kept in a bounded table) and the ids concatenated.

The library cuts a text by a pattern before it merges. A cut is made only where that pattern gives
the same pieces for both sides: at a character boundary, never after white space (the pattern looks
ahead there) and never before an apostrophe (contractions).

Defined results: a null or empty text has no ids and decodes to the empty string; the special
token's string inside a text is that token, as in the library's default; very long texts are encoded whole;
repeated rows stay; an empty table gives an empty one; columns of the results' names are replaced,
others stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, utf8

#: Fragments longer than this are not kept in the table, and the table is emptied at this many.
KEPT_LENGTH, KEPT_FRAGMENTS = 64, 400_000


def _byte_of_char() -> dict[str, int]:
    """The byte behind each printable character that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ForcedBoundaryBpe:
    """One vocabulary file, loaded once per Python worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        byte = _byte_of_char()
        known = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        known |= {i: content for content, i in self.specials.items()}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]
        inside = np.zeros(65536, dtype=bool)
        for i, token in known.items():
            if token not in self.specials:
                b = np.frombuffer(token, dtype=np.uint8).astype(np.uint32)
                inside[b[:-1] * 256 + b[1:]] = True
        first, second = np.divmod(np.arange(65536), 256)
        white = (first >= 9) & (first <= 13) | (first >= 28) & (first <= 32)
        self.cut = ~inside & ~white & (second & 0xC0 != 0x80) & (second != ord("'"))
        self.table: dict[bytes, bytes] = {}

    def _cuts(self, data: bytes) -> list[int]:
        b = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        wide = at[b[at - 1] >= 0x80]
        if len(wide):  # white space of two or three bytes before the cut
            last, mid, lead = b[wide - 1], b[wide - 2], b[np.maximum(wide - 3, 0)]
            two = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
            three = (lead == 0xE1) & (mid == 0x9A) | (lead == 0xE2) & ((mid == 0x80) | (mid == 0x81)) | (lead == 0xE3) & (mid == 0x80)
            at = np.setdiff1d(at, wide[two | three], assume_unique=True)
        return at.tolist()

    def _missing(self, fragment: bytes) -> bytes:
        ids = np.array(self.library.encode(fragment.decode(), add_special_tokens=False).ids, dtype=np.int32).tobytes()
        if len(fragment) <= KEPT_LENGTH:
            if len(self.table) >= KEPT_FRAGMENTS:
                self.table.clear()
            self.table[fragment] = ids
        return ids

    def _plain(self, data: bytes) -> bytes:
        if len(data) < 2:
            return self._missing(data) if data else b""
        at = self._cuts(data)
        get, missing = self.table.get, self._missing
        fragments = [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]
        return b"".join([get(x) or missing(x) for x in fragments])

    def encode(self, data: bytes) -> bytes:
        """The ids of a UTF-8 text as packed 32-bit integers."""
        for special, i in self.specials.items():
            if special in data:
                own = np.array([i], dtype=np.int32).tobytes()
                return own.join(self.encode(part) for part in data.split(special))
        return self._plain(data)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids outside the vocabulary have none; broken UTF-8 becomes U+FFFD."""
        table, n = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by its token ids (array<int>); every other column stays.

    `vocabulary` is the path of a byte-level BPE file at the same place on every machine.
    """
    kept = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*kept).withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in pieces(batches, text):
            packed = [bpe.encode(x) if x else b"" for x in utf8(batch.column(text)).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, ids])

    return map_arrow(docs.select(*kept, text), run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the decoded text of an ids column (null: empty); every other column stays."""
    kept = [c for c in tokens.columns if c != text]
    schema = tokens.select(*kept).withColumn(text, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch.column(ids)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, text])

    return map_arrow(tokens.select(*kept), run, schema)
