"""Near-duplicate documents: MinHash, banding, verification on full sets, connected components.

1. A text's words are hashed in one pass over its bytes; its set is that of the distinct hashes of runs of
   ``k`` words (64 bits, mixed from the words' hashes).
2. Documents with equal sets are one class, named by its smallest id. What follows sees classes only, so
   groups of copies cost nothing.
3. ``BANDS x ROWS`` universal hash minima (a x + b mod 2^64, a odd) are folded into band keys. At a similarity
   of 0.8 all of 40 bands of 5 rows miss with a probability of 1.3e-7.
4. Every class is tied to a pivot of each of its buckets, the smallest id under one of four masks. Those
   pairs, no more than bands in number for each class, are verified on full sets.
5. Links are joined to components. Buckets that then still hold several components, if they hold more than
   two classes, have pairs that no pivot has tested. An exact prefix filter over their members finds all that
   can link two components, and those are verified as well. So no link that shares a bucket is lost,
   while groups that pivots tie together emit no pairs.

Results: null and blank texts have an empty set and are linked with nothing; a text of fewer than ``k``
words has one run, the whole. Rows with one id are one document. Rows with a null id belong to the class of
their set, or to no component (null) if no row of it has an id. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, written
from siltstone.llm.components import components

BANDS, ROWS = 40, 5
#: Pairs of one pivot that go to one task together.
PIVOT_PAIRS = 256
#: Tasks that the pairs of a pivot with more of them are dealt to before that, and nodes of a run and size that are joined together.
SALTS, RUN_NODES = 64, 256
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Bytes of texts that are hashed at once.
SLAB = 1 << 18
#: Masks for the choice of pivots.
MASKS = (0x0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x369DEA0F31A53F85)

WORD_BYTES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        factors = np.full(max(n, 2 * SLAB), base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of bytes whose blanks are 0x20; a word's hash depends on its bytes alone."""
    points = np.frombuffer(data, np.uint8)
    solid = points != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(points)), out=sums[1:])
    values = (sums[ends] - sums[starts]) * _powers(INVERSE, len(points))[starts]
    return _mix(values + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of a document's runs of k words, in order."""
    if not len(words):
        return words
    k = min(k, len(words))
    run = words[: len(words) - k + 1]
    for j in range(1, k):
        run = _mix(run * np.uint64(0xA24BAED4963EE407) + words[j : len(words) - k + 1 + j])
    run = np.sort(_mix(run + np.uint64(k)))
    return run[np.concatenate(([True], run[1:] != run[:-1]))]


def run_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The set of every text, slab by slab; each text is taken whole."""
    slab: list[bytes] = []
    size = 0
    for n, text in enumerate(texts):
        slab.append((text or "").encode("utf-8", "replace").translate(WORD_BYTES))
        size += len(slab[-1]) + 1
        if size >= SLAB or n == len(texts) - 1:
            words, starts = _word_hashes(b" ".join(slab))
            bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in slab]))
            yield from (_runs(words[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
            slab, size = [], 0


def _universal(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    return a[:, None], b[:, None]


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    a, b = _universal(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        np.minimum(least, (a * found[start : start + 2048] + b).min(1), out=least)
    keys = _mix(np.arange(1, bands + 1, dtype=np.uint64))
    for column in least.reshape(bands, rows).T:
        keys = _mix(keys * np.uint64(0xA24BAED4963EE407) + column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, set_key, keys)``; set and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys = [], [], []
            for found in run_sets(batch.column(1).to_pylist(), k):
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(found, bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "keys"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows_in, run, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def _masked(column: str):
    masks = F.array(*[F.lit(m) for m in MASKS])
    return F.col(column).bitwiseXOR(F.element_at(masks, (F.pmod("key", F.lit(len(MASKS))) + 1).cast("int")))


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """``(key, node, pivot)`` of the buckets ``(key, node)`` that several nodes share."""
    least = buckets.groupBy("key").agg(F.min(_masked("node")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return buckets.join(least.select("key", _masked("least").alias("pivot")), "key")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's pivot and each other node of it, each pair once."""
    once = shared.where("node <> pivot").groupBy(F.least("node", "pivot").alias("low"), F.greatest("node", "pivot").alias("high")).agg(F.min("pivot").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of some nodes. Up to ``BROADCAST_IDS`` ids are broadcast, so that texts stay where they are; more are joined by a shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    ids = written(nodes.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    few = ids.count() <= BROADCAST_IDS
    return written(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets.

    The end with more pairs (``a``) is the one others are compared with. Its text goes once to each of the
    tasks that its pairs are dealt to, and texts of ``b`` follow it, so a task holds one set and one batch.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_PAIRS).cast("int").alias("parts"))
    heads = size.join(texts, size.a == texts.doc_id).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    # Pivots of many pairs alone are told to them, and salted, so that no task gets all pairs of one.
    large = size.where("parts > 1").select("a", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = salted.join(large, ["a", "salt"], "left").select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    tails = dealt.join(texts, dealt.b == texts.doc_id).select("a", "part", "b", "text")
    rows = heads.unionAll(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now = None, None
        for batch in batches:
            u, v = [], []
            for a, b, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), run_sets(batch.column(2).to_pylist(), k), strict=True):
                if b is None:
                    head, now = found, a
                elif now == a and len(head) and len(found):
                    at = np.minimum(np.searchsorted(head, found), len(head) - 1)
                    common = int((head[at] == found).sum())
                    if 100 * common >= percent * (len(head) + len(found) - common):
                        u.append(a)
                        v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return map_batches(rows.select("a", "b", "text"), run, "u long, v long")


def across_components(rest: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``rest (node, component)`` that can be links between components.

    Exact prefix filter: a link of sets of m and n runs shares at least o = ceil(percent (m + n) / (100 + percent))
    of them, so the rarest run that both have is among the m - o + 1 rarest of the one and the n - o + 1
    rarest of the other. Runs that few nodes have come first, and edited copies have some of their own, so a
    group of copies gives few pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [found.view(np.int64) for found in run_sets(batch.column(2).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["node", "component", "runs"])

    sets = map_batches(rest.join(texts, rest.node == texts.doc_id).select("node", "component", "text"), run, "node long, component long, runs array<long>")
    runs = written(sets.withColumn("n", F.size("runs")).select("node", "component", "n", F.explode("runs").alias("run")).distinct(), "runs")
    spread = runs.groupBy("run").agg(F.count("*").alias("nodes"), F.min("component").alias("low"), F.max("component").alias("high"))
    ranked = runs.join(spread, "run").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("nodes", "run", (F.col("low") < F.col("high")).alias("shared")))).alias("all"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    # The size of the largest set that a node can be linked with if this run is the first that both have.
    reach = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("at")) / percent) - F.col("n")
    prefix = ranked.select("node", "component", "n", F.posexplode(F.slice("all", F.lit(1), length)).alias("at", "p")).where("p.shared")
    return meeting(written(prefix.select("node", "component", "n", "p.run", reach.alias("reach")), "prefix"))


def meeting(prefix: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``prefix (node, component, n, run, reach)`` that share a run, lie in two components and reach each other's size.

    A run's nodes lie where their size is. Those outside the run's most frequent component go to the sizes in their reach
    that reach theirs and hold another component; the most frequent component's go nowhere. Many small components that all
    reach each other are still pairs in the square of their number, for each such pair is a candidate.
    """
    held = prefix.groupBy("run", "component").agg(F.count("*").alias("nodes"))
    most = held.groupBy("run").agg(F.max(F.struct("nodes", "component"))["component"].alias("most"))
    # A size that many nodes of a run have is joined in parts.
    sizes = written(prefix.groupBy("run", F.col("n").alias("size")).agg(F.max("reach").alias("far"), F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / RUN_NODES).cast("int").alias("parts")), "sizes")
    others = prefix.join(most, "run").where("component <> most")
    told = others.join(sizes, "run").where("size <= reach and n <= far and (low <> component or high <> component)")
    y = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    x = prefix.withColumn("size", F.col("n")).join(sizes, ["run", "size"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    same = (F.col("x.run") == F.col("y.run")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.part") == F.col("y.part"))
    apart = (F.col("x.component") == F.col("y.most")) | (F.col("x.component") < F.col("y.component"))
    return x.join(y, same & apart & (F.col("y.n") <= F.col("x.reach"))).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    signed = written(signatures(docs, k, bands, rows), "signatures")
    named = signed.where("set_key is not null")
    classes = written(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    of_class = named.join(classes, "set_key").where("doc_id = node")
    buckets = of_class.select(F.explode("keys").alias("key"), "node")
    shared = written(shared_buckets(buckets), "shared")
    texts = texts_of(docs, shared)
    pairs = written(pivot_pairs(shared), "pairs")
    links = written(verified(pairs, texts, k, percent), "verified")
    joined = components(links)

    # Buckets of more than two classes that components do not explain.
    marked = shared.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    split = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 and low <> high")
    rest = written(marked.join(split.select("key"), "key").select("node", "component").distinct(), "rest")
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untested = across_components(rest, texts, k, percent).join(tested, ["a", "b"], "left_anti")
    more = written(verified(written(untested, "untested"), texts, k, percent), "verified-more")
    if not more.isEmpty():
        ties = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
        joined = components(ties.unionAll(more))

    found = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    found = found.join(joined, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id.

    Of rows that share an id one stays. Rows with a null id can't be told apart by it and stay.
    """
    found = written(near_duplicates(docs, k, percent).select("doc_id", "kept"), "kept")
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
