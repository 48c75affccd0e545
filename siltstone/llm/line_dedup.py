"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash goes over the hashes of ``SPAN`` lines that are not blank, at every line.
``remove_runs``, which the query and the pipeline use, chooses boundaries where that hash begins or ceases to be one
that stands in several places: a chunk is a run of lines whose rolling hashes all repeat. Boundaries thus depend on
the chunk's own lines alone, wherever it begins and whatever stands beside it, and a repeated chunk of more than
``LONG`` words goes as a whole, be it of several lines or one. Shorter ones stay, as does a line that repeats alone:
they are headings, notices and turns of phrase, and a document that is near another one stays near it.

``remove_repeats`` chooses boundaries without a look at other documents, where the rolling hash is 0 modulo
``PERIOD``. It keeps the head and the tail of each repeated run, up to the first boundary and from the last one on,
and chunks of fewer than ``LEAST`` lines.

A piece that stands in several places is a repeat: the first place (smallest document id, then row, then position)
keeps its lines as far as this piece goes, and the others lose them once their bytes have been compared with the
first's. A line that goes always has an equal line that stays, in an earlier place.

Results: null text stays null; a document of which no line, or blank lines alone, are left goes, all others stay,
with ``text`` and ``n_chars`` (where there is one) as they then are. Documents without repeats are untouched, blank
pieces are no repeats, and rows with a null id are left alone. Rows with one id are told apart by a hash of their
text; equal rows count as one place. Extra columns pass through; those named like the operator's own (``places``,
``kept``, ``removed_lines``, ``row_key_``, ``gone_id``, ``gone_key``) are replaced or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, written

SPAN, PERIOD, LEAST = 2, 3, 2
#: A chunk goes if it has more words than these, and such a line is a piece by itself.
LONG = 50
#: Hashes of repeated pieces that may be broadcast with their first places, about 100 bytes each; more meet the pieces in a shuffle.
BROADCAST_HASHES = 250_000
#: Numbers in the list of removed places that may be broadcast; a longer list meets the texts in a shuffle.
BROADCAST_PLACES = 2_000_000
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))


def chunks(text: str, span: int = SPAN, period: int = PERIOD) -> list[tuple[int, int]]:
    """Chunks of a text's lines as (first line, line after)."""
    lines = text.split("\n")
    hashes = list(map(_hash, lines))
    leaving = pow(FACTOR, span, 1 << 64)
    out, start, rolling = [], 0, 0
    for at, value in enumerate(hashes):
        rolling = (rolling * FACTOR + value) & MASK
        if at >= span:
            rolling = (rolling - hashes[at - span] * leaving) & MASK
        # The high bits, for the low ones of a product depend on low ones alone.
        if at + 1 >= span and (rolling >> 32) % period == 0 or at == len(lines) - 1:
            out.append((start, at + 1))
            start = at + 1
    return out


def _row_key(text: str) -> int:
    return _hash(text) - (1 << 63)


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """Windows of ``SPAN`` lines that are not blank, with the blank lines between them, and long lines, as (first line, line after)."""
    full = [at for at, line in enumerate(lines) if line and not line.isspace()]
    out = [(start, end + 1) for start, end in zip(full, full[SPAN - 1 :], strict=False)]
    return out + [(at, at + 1) for at in full if len(lines[at].split()) > LONG]


def _least(least: int) -> Callable[[list[str]], list[tuple[int, int]]]:
    return lambda lines: [(start, end) for start, end in chunks("\n".join(lines)) if end - start >= least]


def _rolled(hashes: list[int], pieces: list[tuple[int, int]]) -> Iterator[int]:
    """The rolling hash over the line hashes of each piece: sums of powers, so that a piece costs two look-ups however long it is."""
    total, sums = 0, [0]
    for value in hashes:
        total = (total * FACTOR + value) & MASK
        sums.append(total)
    powers = [1]
    for start, end in pieces:
        while len(powers) <= end - start:
            powers.append(powers[-1] * FACTOR & MASK)
        yield ((sums[end] - sums[start] * powers[end - start]) & MASK) - (1 << 63)


PLACED = "doc_id long, row_key long, at int, after int, hash long"


def piece_table(docs: DataFrame, pieces: Callable[[list[str]], list[tuple[int, int]]], bodies: bool) -> DataFrame:
    """``(doc_id, row_key, at, after, hash)`` of every piece, and its ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places, afters, hashes, found = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, lines = _row_key(text), text.split("\n")
                full = [bool(line) and not line.isspace() for line in lines]
                cut = [(start, end) for start, end in pieces(lines) if any(full[start:end])]
                ids += [doc_id] * len(cut)
                keys += [key] * len(cut)
                places += [start for start, _ in cut]
                afters += [end for _, end in cut]
                hashes += _rolled(list(map(_hash, lines)), cut)
                if bodies:
                    found += ["\n".join(lines[start:end]) for start, end in cut]
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(afters, pa.int32()), pa.array(hashes, pa.int64())]
            names = ["doc_id", "row_key", "at", "after", "hash"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.string())] * bodies, names + ["body"] * bodies)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return map_batches(rows, run, PLACED + ", body string" * bodies)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key_``, by which rows of one id are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keys = [None if text is None else _row_key(text) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "row_key_"])

    return map_batches(docs, run, docs._jdf.schema().toDDL() + ", row_key_ long")


def bodies_of(docs: DataFrame, pieces: Callable[[list[str]], list[tuple[int, int]]], repeated: DataFrame, few: bool) -> DataFrame:
    """Pieces of ``repeated (hash, first)`` with their bodies.

    Few hashes are broadcast, and texts stay where they are. Many meet the pieces by their hash first, and each text
    then goes once to its places.
    """
    if few:
        return piece_table(docs, pieces, True).join(F.broadcast(repeated), "hash")
    places = piece_table(docs, pieces, False).join(repeated.select("hash"), "hash").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("at", "after", "hash")).alias("found"))
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    met = texts.withColumnRenamed("row_key_", "row_key").dropDuplicates(["doc_id", "row_key"]).join(places, ["doc_id", "row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                rows += [(doc_id, key, p["at"], p["after"], p["hash"], "\n".join(lines[p["at"] : p["after"]])) for p in found]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], ["doc_id", "row_key", "at", "after", "hash", "body"])

    return map_batches(met.select("doc_id", "row_key", "text", "found"), run, PLACED + ", body string").join(repeated, "hash")


def repeats(docs: DataFrame, pieces: Callable[[list[str]], list[tuple[int, int]]]) -> DataFrame:
    """``(doc_id, row_key, places)``: lines that go, as (first line, line after), by document."""
    place = F.struct("doc_id", "row_key", "at", "after")
    by_hash = piece_table(docs, pieces, False).groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    repeated = written(by_hash.select("hash", "first"), "repeated")
    # Bodies are made again for repeats alone: those of all pieces would be the texts twice over.
    found = written(bodies_of(docs, pieces, repeated, repeated.count() <= BROADCAST_HASHES).withColumn("is_first", place == F.col("first")), "repeats")
    first = found.where("is_first").groupBy("hash").agg(F.first("body").alias("first_body"))
    # One row of a hash meets all its repeats; a hash with many is split by the adaptive skew join.
    equal = found.where("not is_first").join(first, "hash").where("body = first_body")
    # A piece that overlaps its own first place leaves that one's lines.
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    start = F.when(own, F.greatest("at", "first.after")).otherwise(F.col("at"))
    return equal.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct(start.alias("at"), "after")).alias("places"))


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents without repeated chunks of ``least`` lines; columns as in ``remove_runs``."""
    return _remove(docs, _least(least))


def remove_runs(docs: DataFrame, words: int = LONG) -> DataFrame:
    """Documents without repeated chunks of more than ``words`` words; ``removed_lines`` tells how many lines went, ``kept`` whether any line is left."""
    return _remove(docs, windows, words)


def _long_runs(lines: list[str], taken: set[int], words: int) -> set[int]:
    """Of lines that go, those of runs of more than so many words; blank lines between two of them belong to the run."""
    out: set[int] = set()
    run: list[int] = []
    for at, line in enumerate([*lines, "end"]):
        if at in taken:
            run.append(at)
        elif line and not line.isspace() and run:
            if sum(len(lines[n].split()) for n in run) > words:
                out.update(run)
            run = []
    return out


def _remove(docs: DataFrame, pieces: Callable[[list[str]], list[tuple[int, int]]], words: int = 0) -> DataFrame:
    docs = docs.drop("removed_lines", "kept", "places", "row_key_", "gone_id", "gone_key")
    gone = written(repeats(docs, pieces).withColumnsRenamed({"doc_id": "gone_id", "row_key": "gone_key"}), "gone")
    places = gone.agg(F.sum(2 * F.size("places") + 4)).first()[0] or 0
    gone = F.broadcast(gone) if places <= BROADCAST_PLACES else gone

    rows = keyed(docs)
    joined = rows.join(gone, (rows.doc_id == gone.gone_id) & (rows.row_key_ == gone.gone_key), "left").drop("gone_id", "gone_key", "row_key_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, removed, kept = [], [], []
            for text, places in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("places")).to_pylist(), strict=True):
                if not places:
                    texts.append(text)
                    removed.append(0)
                    kept.append(True)
                    continue
                lines = text.split("\n")
                taken = {at for place in places for at in range(place["at"], place["after"])}
                if words:
                    taken = _long_runs(lines, taken, words)
                left = [line for at, line in enumerate(lines) if at not in taken]
                texts.append("\n".join(left))
                removed.append(len(lines) - len(left))
                kept.append(not taken or any(line and not line.isspace() for line in left))
            columns = {n: batch.column(names.index(n)) for n in names if n != "places"} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(removed, pa.int64()), pa.array(kept, pa.bool_())], [*columns, "removed_lines", "kept"])

    out = map_batches(joined, cut, docs._jdf.schema().toDDL() + ", removed_lines long, kept boolean")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
