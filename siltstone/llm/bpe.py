"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are short; parts are encoded on their own and neighbours are joined on
the way up. A join encodes a window around the seam again and keeps the tokens outside it. The window
grows until both its ends are stable points.

A stable point is a place before a space or a line feed that follows a character that is not white space.
The splitting pattern always ends a match there: matches with other characters hold white space only as
their first character. What follows such a point is split without regard to what precedes it, since the
pattern looks ahead only and matches from left to right; and no match before it looks past it, since only
white-space matches look ahead. Matches are encoded one by one, so ids outside the window cannot change.
An end of the text counts as stable.

Results: null text is empty text; an empty text has no ids and decodes to no bytes. Repeated rows give
repeated results. Any length is taken; a text without stable points is encoded in one window.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches

#: Characters in a part that is encoded at once, and in the first window of a join.
LEAF, WINDOW = 4096, 64


class TreeCodec:
    """Encoder and decoder for a rank file in base64 lines (token, rank)."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.library.encode_ordinary(text)
        middle = len(text) // 2
        return self.join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def join(self, text: str, seam: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of ``text`` from those of its two parts."""
        start = self._stable_before(text, seam)
        end = self._stable_after(text, seam)
        left_bytes, right_bytes = len(text[start:seam].encode()), len(text[seam:end].encode())
        keep = len(left)
        while left_bytes > 0:
            keep -= 1
            left_bytes -= len(self.token_bytes[left[keep]])
        skip = 0
        while right_bytes > 0:
            right_bytes -= len(self.token_bytes[right[skip]])
            skip += 1
        if left_bytes or right_bytes:
            raise AssertionError("a window ends inside a token")
        return left[:keep] + self.library.encode_ordinary(text[start:end]) + right[skip:]

    def _stable_before(self, text: str, seam: int) -> int:
        width, high = self.window, seam
        while high > 0:
            low = max(1, seam - width)
            for at in range(high - 1, low - 1, -1):
                if text[at] in " \n" and not text[at - 1].isspace():
                    return at
            high, width = low if low > 1 else 0, 2 * width
        return 0

    def _stable_after(self, text: str, seam: int) -> int:
        width, low = self.window, seam
        while low < len(text):
            high = min(len(text), seam + width)
            for at in range(low, high):
                if text[at] in " \n" and not text[at - 1].isspace():
                    return at
            low, width = high, 2 * width
        return len(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.library.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_CODECS: dict[tuple, TreeCodec] = {}


def codec(ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> TreeCodec:
    """One codec a worker process."""
    key = (ranks_path, pattern, leaf, window)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(*key)
    return _CODECS[key]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids)`` of every text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(ranks_path, pattern)
        for batch in batches:
            ids = [tree.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    return map_batches(docs.select(id_column, text_column), run, f"`{id_column}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``(id, decoded)`` of every list of ids; null ids are an empty list."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(ranks_path, pattern)
        for batch in batches:
            data = [tree.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_column, "decoded"])

    return map_batches(encoded.select(id_column, "ids"), run, f"`{id_column}` {kind}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest in one pass, so that ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(ranks_path, pattern)
        decimal = tree.decimal.__getitem__
        for batch in batches:
            counts, id_digests, byte_digests = [], [], []
            for text in batch.column(1):
                ids = tree.encode(text.as_py() or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
