"""Token ids in ORC.

Documents are put in order of their id by a range exchange (one that many rows share is dealt by the beginnings of their
texts as well), encoded, and written as ORC: ids as integer
lists in run-length encoding, row indexes, and Bloom filters on document ids, so that a reader takes whole
stripes in parallel and a lookup skips those that cannot hold its ids. Each row keeps the number of its
file and the ids before it in that file; adding up the files' totals gives its place in the whole
sequence without a sort in one task.

White space is a hard boundary of the tokenizer (its splitter keeps none), so ids of a text are those of
its words one after another. Words are encoded by the library in batches and remembered in a bounded table.

Results: null text is empty and has the end id alone. Rows with one doc_id stand in order of their text;
a null doc_id stands first.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import gathered, map_batches, written

END_ID = 2
#: Words in each generation that a worker remembers.
MEMO_WORDS = 500_000
#: Latin letters whose words are their own normal form once small (but for one whose small form has a mark), and marks that close words (but for the apostrophe, which the tokenizer's rule puts to letters).
LETTERS, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Plain words in one call of the library.
LINE_WORDS = 50
#: Bytes of texts whose distinct words are looked up together.
GATHER_BYTES = 8 << 20
STRIPE_BYTES, STRIDE = 16 << 20, 2000
#: Rows of one id from which on their texts' first characters deal them.
TIES, PREFIX = 10_000, 64


def _plain_library(whole):
    """The tokenizer for lines of small Latin words: its splitting rule finds each of them whole, so blanks suffice."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    made = Tokenizer.from_str(whole.to_str())
    made.normalizer = normalizers.Sequence([])
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class WordEncoder:
    """Ids of whole texts by way of their distinct words.

    Words are remembered in two generations: a full young one becomes the old one, and what is still used
    moves back, so frequent words stay and memory is bounded. The last id of a word is marked as such in the
    vocabulary, so plain words go to the library many in a line and come apart at these ids.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = _plain_library(self.library)
        suffix = self.library.model.end_of_word_suffix
        self.closes = np.zeros(self.library.get_vocab_size(), bool)
        self.closes[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.tails: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _one(self, word: str) -> bytes:
        made = self.library.encode(word, add_special_tokens=False)
        return struct.pack(f"<{len(made)}I", *made.ids)

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of small Latin words."""
        out: list[bytes] = []
        for start in range(0, len(words), 5000):
            part = words[start : start + 5000]
            lines = [" ".join(part[k : k + LINE_WORDS]) for k in range(0, len(part), LINE_WORDS)]
            ids = np.concatenate([np.array(made.ids, "<u4") for made in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(part):
                out += map(self._one, part)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _of_tails(self, tails: list[str]) -> pa.Array:
        if len(self.tails) + len(tails) > self.memo_words:
            self.tails = {}
        for tail in tails:
            if tail not in self.tails:
                self.tails[tail] = self._one(tail)
        return pa.array([self.tails[tail] for tail in tails], pa.binary())

    def _of_words(self, words: list[str], plain: list[bool]) -> list[bytes]:
        if len(self.young) + len(words) > self.memo_words:
            self.young, self.old = {}, self.young
        young, found = self.young, list(map(self.young.get, words))
        missing = [n for n, ids in enumerate(found) if ids is None]
        easy, hard = [], []
        for n in missing:
            ids = self.old.get(words[n])
            if ids is None:
                (easy if plain[n] else hard).append(n)
            else:
                found[n] = young[words[n]] = ids
        for part, made in ((easy, self._plain_words([words[n] for n in easy])), (hard, map(self._one, [words[n] for n in hard]))):
            for n, ids in zip(part, made, strict=True):
                found[n] = young[words[n]] = ids
        return found

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Lists of ids, each with the end id; nulls are empty texts."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        keys, tails = _parts(coded.dictionary)
        plain = pc.match_substring_regex(keys.dictionary, PLAIN).to_pylist()
        pieces = pa.array(self._of_words(keys.dictionary.to_pylist(), plain), pa.binary())
        # A word is its letters' ids and its marks'; a text is its words' and the end id.
        whole = pc.binary_join_element_wise(pieces.take(keys.indices), self._of_tails(tails.dictionary.to_pylist()).take(tails.indices), pa.scalar(b"", pa.binary()))
        whole = pa.concat_arrays([whole, pa.array([struct.pack("<I", end_id)], pa.binary())])
        ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        laid = whole.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(whole) - 1)))
        _, bounds, data = laid.buffers()
        stops = np.frombuffer(bounds, np.int32)[: len(laid) + 1]
        offsets = np.concatenate(([0], stops[ends + np.arange(1, len(texts) + 1)])).astype(np.int32) // 4
        ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, data])
        return pa.ListArray.from_arrays(pa.array(offsets), ids)


PLAIN = f"^{LETTERS}+$"


def _parts(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each word less its closing marks, and these marks.

    The tokenizer keeps letters and marks apart, takes a run of marks as one piece and capitals as small
    letters. So Latin letters with marks behind them are the letters' ids and the marks', and Latin words are
    small ones. Any other word stays whole and has no marks.
    """
    left = pc.utf8_rtrim(words, MARKS)
    latin = pc.match_substring_regex(left, PLAIN)
    keys = pc.if_else(latin, pc.utf8_lower(left), words)
    tails = pc.replace_substring_regex(pc.if_else(latin, words, ""), f"^{LETTERS}+", "")
    return keys.dictionary_encode(), tails.dictionary_encode()


_ENCODERS: dict[str, WordEncoder] = {}


def store(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write; the returned table reads the files: doc_id, ids, n_tokens, part, before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder, part, total = _ENCODERS[tokenizer_path], TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 1, GATHER_BYTES):
            if batch.num_rows:
                ids = encoder.encode(batch.column(1), end_id)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                ends = total + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes), pa.array(np.full(len(sizes), part, np.int64)), pa.array(ends - sizes)], ["doc_id", "ids", "n_tokens", "part", "before"])
                total = int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Ids alone are read for the ranges' bounds, unless one has so many rows that it must be dealt.
    most = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    ranges = ["doc_id"] if most <= TIES else ["doc_id", F.substring("text", 1, PREFIX)]
    ordered = docs.select("doc_id", "text").repartitionByRange(*ranges).sortWithinPartitions("doc_id", "text")
    encoded = map_batches(ordered, run, f"doc_id {kind}, ids array<int>, n_tokens long, part long, before long")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    return written(encoded, "token-store", "orc", **options)


def placed(stored: DataFrame) -> DataFrame:
    """Stored rows with ``start``, the ids of all rows before. One row a file is summed up, not one a document."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # A file's row: as many as there were tasks, which the session's settings bound.
    offsets = totals.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))
    return stored.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("before")).drop("part", "before", "offset")


def lookup(stored: DataFrame, doc_ids: list) -> DataFrame:
    """Rows of some ids; row indexes and Bloom filters let the reader skip stripes."""
    return stored.where(F.col("doc_id").isin(doc_ids))


def digests(stored: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_batches(placed(stored).select("doc_id", "start", "n_tokens", "ids"), run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
