"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

A document's words are streamed through the automaton, which keeps the longest match that ends at each
word. A match of ``window`` words or more is a hit, and so is a whole item that is shorter than a window.

The automaton lives in memory, so items are dealt into groups of at most ``GROUP_WORDS`` words (a longer
item is cut into overlapping pieces). The driver reads items as a stream and makes automata for ``WAVE`` groups at a
time; documents pass a wave in one Python worker a task, which holds one automaton and ``HELD`` bytes of texts, and
are written before the next wave. What the driver, a broadcast and a worker hold is thus bounded, however large the
benchmark is; time grows with the number of groups, for every document meets every group.

Results: null text has no words and no hits; items without words or with a null id take no part; repeated
items with one id count as one item; without items nothing is hit. Other columns pass through; one named
``matches`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, written

WINDOW = 8
GROUP_WORDS = 200_000
#: Groups that are broadcast together, and bytes of texts that meet them one after another.
WAVE, HELD = 4, 32 << 20
#: Documents that hold this part of an item's words in one run go; shorter runs are cut out.
ITEM_SHARE = 0.5

#: Bytes of words in lower case; all others become blanks.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


class Automaton:
    """States of a generalised suffix automaton, as it is built; state 0 is the root."""

    def __init__(self, items: Iterable[tuple[str, list[bytes], int]], window: int = WINDOW):
        """items: (id, words, words of the whole item), where words may be a piece of an item."""
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for name, words, size in items:
            if not words:
                continue
            last = 0
            for word in words:
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
            paths.append((len(self.names), words))
            self.names.append(name)
            self.sizes.append(size)
        holders: list[set[int]] = [set() for _ in self.next]
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for item, words in paths:
            state = 0
            for word in words:
                state = self.next[state][self.number[word]]
                up = state
                while up > 0 and item not in holders[up]:
                    holders[up].add(item)
                    up = self.link[up]
            if self.sizes[item] < window:
                self.ends.setdefault(state, []).append((len(words), item))
        # Equal sets are one: a passage that every item holds has many states and one set.
        known: dict[frozenset, int] = {}
        self.holder = [known.setdefault(frozenset(found), len(known)) for found in holders]
        self.sets = list(known)
        self.shortest = [min((self.sizes[i] for i in found), default=1) for found in holders]

    def packed(self) -> tuple:
        """What a matcher is made of, as arrays."""
        width = len(self.number)
        edges = [(state * width + word, to) for state, following in enumerate(self.next) for word, to in following.items()]
        short = [(state, size, item) for state, found in self.ends.items() for size, item in found]
        numbers = (np.array(x, np.int64) for x in (self.link, self.length, self.holder, self.shortest, np.reshape(edges, (-1, 2)), np.reshape(short, (-1, 3))))
        sets = np.concatenate([np.array(sorted(found), np.int32) for found in self.sets] or [np.empty(0, np.int32)])
        return self.window, b" ".join(self.number), self.names, *numbers, np.cumsum([0, *map(len, self.sets)]), sets

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._add(self.length[last] + 1, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._add(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, length: int, following: dict[int, int], link: int = 0) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


class Matcher:
    """An automaton to stream words through."""

    def __init__(self, packed: tuple):
        self.window, words, self.names, link, length, holder, shortest, edges, short, bounds, sets = packed
        self.number = {word: n for n, word in enumerate(words.split())}
        self.width = len(self.number)
        self.link, self.length, self.shortest = link.tolist(), length.tolist(), shortest.tolist()
        self.next = dict(zip(edges[:, 0].tolist(), edges[:, 1].tolist(), strict=True))
        self.bounds, self.sets = bounds, sets
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        own: dict[int, list[tuple[int, int]]] = {}
        for state, size, item in short.tolist():
            own.setdefault(state, []).append((size, item))
        #: For each state the set of items that hold its last words, as many as a window has.
        self.holder = holder.tolist()
        for state in np.argsort(length, kind="stable").tolist()[1:]:
            up = self.link[state]
            self.short[state] = self.short[up] + tuple(own.get(state, ()))
            if self.length[up] >= self.window:
                self.holder[state] = self.holder[up]
        self.live = [n >= self.window or bool(found) for n, found in zip(self.length, self.short, strict=True)]

    def items(self, held: set[int]) -> set[int]:
        return {int(i) for n in held for i in self.sets[self.bounds[n] : self.bounds[n + 1]]}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], float]:
        """Hit runs of words as (start, end), items with occurring windows, and the largest share of an item in one match."""
        number, following, width, link, length, live, window = self.number.get, self.next, self.width, self.link, self.length, self.live, self.window
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        held: set[int] = set()
        share, state, matched = 0.0, 0, 0
        for at, word in enumerate(map(number, words)):
            if word is None:
                state = matched = 0
                continue
            while state and state * width + word not in following:
                state = link[state]
                matched = length[state]
            to = following.get(state * width + word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if not live[state]:
                continue
            start = at + 1
            if matched >= window:
                start = at + 1 - window
                held.add(self.holder[state])
                share = max(share, matched / self.shortest[state])
            for size, item in self.short[state]:
                if size <= matched:
                    start = min(start, at + 1 - size)
                    found.add(item)
                    share = 1.0
            while runs and runs[-1][1] >= start and start <= at:
                start = min(start, runs.pop()[0])
            if start <= at:
                runs.append((start, at + 1))
        return runs, found | self.items(held), share


def groups_of(benchmark: DataFrame, window: int = WINDOW, limit: int = GROUP_WORDS) -> Iterator[list[tuple[str, list[bytes], int]]]:
    """Items as (id, words, size) in groups of at most ``limit`` words."""
    group, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(row.text)
        for start in range(0, max(1, len(words) - window + 1), max(1, limit - window + 1)):
            piece = words[start : start + limit]
            if group and held + len(piece) > limit:
                yield group
                group, held = [], 0
            group.append((row.item_id, piece, len(words)))
            held += len(piece)
    if group:
        yield group


MATCHES = "n_words long, runs array<struct<start:int,end:int>>, items array<string>, share double"


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def match(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW, limit: int = GROUP_WORDS) -> DataFrame:
    """``docs`` with a struct ``matches``: words, hit runs, items with occurring windows, largest share of an item."""
    context = docs.sparkSession.sparkContext
    docs = docs.drop("matches")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "matches"]
    schema = ", ".join([*fields, f"matches struct<{MATCHES.replace(' long', ':long').replace('runs ', 'runs:').replace('items ', 'items:').replace(' double', ':double')}>"])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("share", pa.float64())])
    def through(rows: DataFrame, wave: list[tuple]) -> DataFrame:
        shared = context.broadcast(wave)

        def matched(held: list[pa.RecordBatch], matcher: Callable[[int], Matcher]) -> Iterator[pa.RecordBatch]:
            names = held[0].schema.names
            before = [b.column(names.index("matches")).to_pylist() if "matches" in names else [None] * b.num_rows for b in held]
            found = [[old or {"n_words": 0, "runs": [], "items": [], "share": 0.0} for old in olds] for olds in before]
            for number in range(len(shared.value)):
                automaton = matcher(number)
                for batch, rows in zip(held, found, strict=True):
                    for text, row in zip(batch.column(names.index(text_column)), rows, strict=True):
                        words = words_of(text.as_py())
                        runs, items, share = automaton.scan(words)
                        row["n_words"] = len(words)
                        if runs:
                            row["runs"] = _union([(r["start"], r["end"]) for r in row["runs"]], runs)
                            row["items"] = sorted({automaton.names[i] for i in items}.union(row["items"]))
                            row["share"] = max(share, row["share"])
            kept = [n for n in names if n != "matches"]
            for batch, rows in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(rows, kind)], [*kept, "matches"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, last = [], 0, []

            def matcher(number: int) -> Matcher:
                if not last or last[0] != number:
                    last[:] = []
                    last[:] = [number, Matcher(shared.value[number])]
                return last[1]

            for batch in batches:
                held.append(batch)
                size += batch.column(batch.schema.get_field_index(text_column)).nbytes
                # One automaton stays, so texts need not wait for each other.
                if size >= HELD or len(shared.value) == 1:
                    yield from matched(held, matcher)
                    held, size = [], 0
            if held:
                yield from matched(held, matcher)

        return map_batches(rows, run, schema)

    out, wave = docs, []
    for group in groups_of(benchmark, window, limit):
        if len(wave) == WAVE:
            out, wave = written(through(out, wave), "matches"), []
        wave.append(Automaton(group, window).packed())
    return through(out, wave or [Automaton([], window).packed()])


def hit_words() -> Column:
    return F.aggregate("matches.runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, lengths = [], batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else []
        for n, (text, matches) in enumerate( zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("matches")).to_pylist(), strict=True)):
            if matches["runs"]:
                places = [m.span() for m in WORD.finditer(text)]
                kept, at = [], 0
                for run in matches["runs"]:
                    kept.append(text[at : places[run["start"]][0]])
                    at = places[run["end"] - 1][1]
                text = "".join(kept) + text[at:]
                if lengths:
                    lengths[n] = len(text)
            texts.append(text)
        columns = {name: batch.column(names.index(name)) for name in names if name != "matches"} | {"text": pa.array(texts, pa.string())}
        if lengths:
            columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def remove(docs: DataFrame, benchmark: DataFrame, item_share: float = ITEM_SHARE, window: int = WINDOW) -> DataFrame:
    """Documents without the benchmark: those that hold ``item_share`` of an item in one run go, shorter hit runs are cut out; ``n_chars`` follows the text."""
    found = match(docs, benchmark, window=window).where(F.col("matches.share") < item_share)
    return map_batches(found, _cut, docs.drop("matches")._jdf.schema().toDDL())
