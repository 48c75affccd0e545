"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length 1 and cut into pieces of ``PIECE`` dimensions; each piece is coded by one of 16
centroids, four bits. Codes and centroids minimise a loss that weighs the residual's part parallel to the
vector ``WEIGHT`` times as much as the rest, for that part changes the largest inner products. With cells (below) the
difference from the cell's centroid is coded, whose product with a query is the same for all rows of a chunk. A query's
table of products with the centroids, two pieces to a byte, scores every code by look-ups; the best of each
chunk are scored again with the original vectors in double precision. Rows of equal code share one place among
the best, so copies of a vector push no other out; of equal vectors a chunk scans those with the smallest ids.

Centroids are fitted on a bounded sample: the ``SAMPLE`` vectors with the smallest hash of their id, fewer if they are
longer than 512, so that no more than ``SAMPLE_VALUES`` components reach the driver. Every row is indexed. Large tables are cut into cells as well, one for every ``CELL_ROWS`` rows up to ``CELLS``: a row lies in the
cell of its nearest coarse centroid, and a query looks into as many of the nearest cells as the sample needs for a
recall of ``TARGET``, each sampled vector being sought among the others. The sample is sparser than the table, so its
neighbours lie further off and its recall is the lower one. Where it needs most of the cells, as for vectors without
clusters, there is one cell, and every query scans every row. A cell's rows are dealt to as many slots as it has chunks
for, so a cell that holds a third of all rows is no single task.

Rows are packed into chunks of ``CHUNK`` where they lie; queries are packed into blocks, which go once to each slot of
their cells, so neither side is collected. A slot keeps each query's nearest only, and those meet in one aggregation.

Results: repeated rows of one id and vector are one query, rows of one id with other vectors are queries of their
own, each with ranks from 1. A vector that is null, zero, or holds null or non-finite components takes no part, nor does one whose
length is not the most frequent one (the smaller of two such). Ties go to the smaller id. Rows that share an
id with the query are not its neighbours; other repeated rows are neighbours of their own. Extra columns are
not read. With fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, written

PIECE, CENTROIDS = 2, 16
WEIGHT = 4.0
SAMPLE, ROUNDS = 8192, 8
#: Components of all sampled vectors together, 8 bytes each in the driver, and losses that are weighed at once.
SAMPLE_VALUES, SLAB_VALUES = 1 << 22, 1 << 20
CHUNK, BLOCK = 2048, 1024
#: Of a chunk's rows, the share of places for codes whose rows are scored exactly for each query.
RERANK = 1 / 16
#: Rows a cell, cells at most, the recall that a query's cells are to give in the sample, and vectors that are sought for it.
CELL_ROWS, CELLS, TARGET, PROBES = 65_536, 256, 0.97, 256
#: The share of cells from which on there is one cell, and chunks in a slot.
FLAT, SLOT_CHUNKS = 0.5, 256


def valid(column: str = "embedding") -> Column:
    """Not null, not zero, finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of valid vectors of the most frequent length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid())
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Centroids ``(pieces, 16, PIECE)`` fitted to the anisotropic loss.

    What is coded of a vector is its difference from a base, its cell's centroid; the loss weighs the error along the
    vector itself.
    """

    def __init__(self, sample: np.ndarray, weight: float = WEIGHT, rounds: int = ROUNDS, seed: int = 3, base: np.ndarray | float = 0.0):
        self.dims, self.weight = sample.shape[1], weight
        self.pieces = -(-self.dims // PIECE)
        x, y = self._cut(unit(sample)), self._cut(unit(sample) - base)
        draw = np.random.default_rng(seed)
        self.centroids = np.stack([y[draw.choice(len(y), CENTROIDS, replace=len(y) < CENTROIDS), p] for p in range(self.pieces)])
        for _ in range(rounds):
            codes = self._codes(x, passes=1, y=y)
            self._refit(x, y, codes)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.pieces * PIECE))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.pieces, PIECE)

    def _codes(self, x: np.ndarray, passes: int = 2, y: np.ndarray | None = None) -> np.ndarray:
        """Codes by coordinate descent; the parallel residual couples the pieces of a vector.

        The loss of residual r of y, which is a unit vector x less its base, is |r|^2 + (weight - 1) (r . x)^2.
        Vectors are independent, and are coded in slabs, so what is held doesn't grow with their number or length.
        """
        y = x if y is None else y
        slab = max(1, SLAB_VALUES // (self.pieces * CENTROIDS))
        if len(x) > slab:
            return np.concatenate([self._codes(x[n : n + slab], passes, y[n : n + slab]) for n in range(0, len(x), slab)])
        codes = np.empty((len(x), self.pieces), np.uint8)
        gap = np.empty((self.pieces, len(x), CENTROIDS))
        along = np.empty_like(gap)
        for p in range(self.pieces):
            residual = y[:, p, None, :] - self.centroids[p][None]
            gap[p] = (residual**2).sum(2)
            along[p] = (residual * x[:, p, None, :]).sum(2)
            codes[:, p] = gap[p].argmin(1)
        rows = np.arange(len(x))
        total = sum(along[p][rows, codes[:, p]] for p in range(self.pieces))
        for _ in range(passes):
            for p in range(self.pieces):
                rest = total - along[p][rows, codes[:, p]]
                codes[:, p] = (gap[p] + (self.weight - 1) * (rest[:, None] + along[p]) ** 2).argmin(1)
                total = rest + along[p][rows, codes[:, p]]
        return codes

    def _refit(self, x: np.ndarray, y: np.ndarray, codes: np.ndarray) -> None:
        """Centroids that minimise the loss with all other pieces held."""
        eta = self.weight - 1
        rows = np.arange(len(x))
        residual = np.stack([((y[:, p] - self.centroids[p][codes[:, p]]) * x[:, p]).sum(1) for p in range(self.pieces)], 1)
        for p in range(self.pieces):
            rest = residual.sum(1) - residual[:, p]
            own = (y[:, p] * x[:, p]).sum(1)
            for c in range(CENTROIDS):
                at = rows[codes[:, p] == c]
                if len(at) == 0:
                    continue
                along = x[at, p]
                left = len(at) * np.eye(PIECE) + eta * along.T @ along
                right = y[at, p].sum(0) + eta * ((rest[at] + own[at])[:, None] * along).sum(0)
                self.centroids[p, c] = np.linalg.solve(left, right)
            residual[:, p] = ((y[:, p] - self.centroids[p][codes[:, p]]) * x[:, p]).sum(1)

    def encode(self, x: np.ndarray, base: np.ndarray | float = 0.0) -> np.ndarray:
        """Two four-bit codes to a byte."""
        x = unit(x)
        codes = self._codes(self._cut(x), y=self._cut(x - base))
        if self.pieces % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte the 256 sums of two products."""
        single = np.einsum("qpd,pcd->qpc", self._cut(unit(queries)), self.centroids)
        if self.pieces % 2:
            single = np.concatenate([single, np.zeros((len(single), 1, CENTROIDS))], 1)
        return (single[:, 1::2, :, None] + single[:, ::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores of every query and code."""
    score = np.take(tables[:, 0], codes[:, 0], axis=1)
    for byte in range(1, codes.shape[1]):
        score += np.take(tables[:, byte], codes[:, byte], axis=1)
    return score


class Cells:
    """Coarse centroids and how many of the nearest ones a query looks into."""

    def __init__(self, sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 5):
        x = unit(sample)
        draw = np.random.default_rng(seed)
        count = max(1, min(count, len(x)))
        # First centroids are drawn by their distance from those before, so that a large cluster gets no more than others.
        picked = [int(draw.integers(len(x)))]
        gap = 1 - x @ x[picked[0]]
        while len(picked) < count and gap.max() > 1e-9:
            weight = np.maximum(gap, 0)
            picked.append(int(draw.choice(len(x), p=weight / weight.sum())))
            gap = np.minimum(gap, 1 - x @ x[picked[-1]])
        count = len(picked)
        self.centroids, self.probes = x[picked], 1
        for _ in range(rounds if count > 1 else 0):
            cell = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, cell, x)
            full = np.abs(sums).max(1) > 0
            self.centroids[full] = unit(sums[full])
        if count > 1:
            self.probes = self._needed(x, draw)
        if self.probes > FLAT * count:
            self.centroids, self.probes = self.centroids[:1], 1

    def base(self, cell: int | np.ndarray) -> np.ndarray | float:
        """What vectors of a cell are coded against; one cell has none."""
        return self.centroids[cell] if len(self.centroids) > 1 else 0.0

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-(unit(x) @ self.centroids.T), axis=1, kind="stable")[:, :count]

    def _needed(self, x: np.ndarray, draw: np.random.Generator, k: int = 5) -> int:
        """Cells that hold ``TARGET`` of the k nearest of sampled vectors among the others."""
        asked = draw.choice(len(x), min(PROBES, len(x)), replace=False)
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        found = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :k]
        cell, order = self.nearest(x, 1)[:, 0], self.nearest(x[asked], len(self.centroids))
        rank = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(rank, cell[found], 1).reshape(-1))
        return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def _packed(rows: DataFrame, size: int, quantiser: Quantiser | None, cells: Cells | None = None) -> DataFrame:
    """Rows of each partition in packs of ``size`` of one cell: ids, vectors, codes, as bytes.

    ``rows`` have a ``cell``, or lie in their nearest one of ``cells``. A task holds eight packs' rows at most, and
    closes its largest pack when it holds more.
    """
    shared = rows.sparkSession.sparkContext.broadcast((quantiser, cells))
    names = ["vec_id", "embedding"] + ["cell"] * ("cell" in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, coarse = shared.value
        part, number, held = TaskContext.get().partitionId(), 0, 0
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def pack(cell: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            ids, vectors = (np.concatenate(side) for side in zip(*open_.pop(cell), strict=True))
            held -= len(ids)
            for start in range(0, len(ids), size):
                i, v = ids[start : start + size], vectors[start : start + size]
                codes = coder.encode(v, coarse.base(cell)).tobytes() if coder is not None else None
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([cell], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([codes], pa.binary())], ["pack", "cell", "ids", "vectors", "codes"])
                number += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            own = batch.column(2).to_numpy() if len(names) == 3 else coarse.nearest(vectors, 1)[:, 0]
            for cell in np.unique(own).tolist():
                mine = own == cell
                open_.setdefault(cell, []).append((ids[mine], vectors[mine]))
                held += int(mine.sum())
                if sum(len(i) for i, _ in open_[cell]) >= size:
                    yield from pack(cell)
            while held > 8 * size:
                yield from pack(max(open_, key=lambda c: sum(len(i) for i, _ in open_[c])))
        for cell in list(open_):
            yield from pack(cell)

    return map_batches(rows.select(*names), run, "pack long, cell int, ids binary, vectors binary, codes binary")


def _probing(asked: DataFrame, cells: Cells) -> DataFrame:
    """Every query once for each cell that it looks into."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = shared.value
        for batch in batches:
            if batch.num_rows:
                found = coarse.nearest(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), coarse.probes)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.reshape(-1).astype(np.int32))], ["vec_id", "embedding", "cell"])

    return map_batches(asked.select("vec_id", "embedding"), run, "vec_id long, embedding array<double>, cell int")


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[Quantiser, Cells] | None:
    total = rows.count()
    if not total:
        return None
    first = rows.first().embedding
    sample = max(1, min(sample, SAMPLE_VALUES // len(first)))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.where(draw <= min(1.0, (sample + 4 * sample**0.5) / total)).orderBy(draw, "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    x = found.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(first)) if len(found) else np.array([first])
    cells = Cells(x, min(CELLS, total // CELL_ROWS))
    return Quantiser(x, base=cells.base(cells.nearest(x, 1)[:, 0])), cells


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, rerank: float = RERANK, parts: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the k rows of ``vectors`` with the largest cosine found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    fitted = fit(rows)
    kinds = "query_id long, query long, vec_id long, score double"
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser, cells = fitted
    # A cell's rows are alike and harder to rank by codes: of the fewer chunks that a query meets more is scored exactly.
    rerank = min(1.0, rerank * len(cells.centroids) / cells.probes)
    parts = parts or max(16, 4 * spark.sparkContext.defaultParallelism)
    chunks = written(_packed(rows, CHUNK, quantiser, cells), "index")
    # A row a cell, CELLS of them at most.
    counts = {r.cell: r["count"] for r in chunks.groupBy("cell").count().collect()}
    total = sum(counts.values())
    slots = [max(1, -(-counts.get(c, 0) * parts // total), -(-counts.get(c, 0) // SLOT_CHUNKS)) for c in range(len(cells.centroids))]
    of_cell = F.element_at(F.array(*map(F.lit, slots)), F.col("cell") + 1)
    chunks = chunks.withColumn("slot", F.pmod(F.xxhash64("pack"), of_cell).cast("int"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid() & (F.size("embedding") == quantiser.dims)).distinct()
    few = max(1, -(-asked.count() * cells.probes // BLOCK))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(-(-few // len(cells.centroids))))
    # A task packs many blocks if there are many, so tasks do not grow with the queries; sorted, a cell's rows come together.
    dealt = _probing(asked, cells).repartition(min(few, 4 * parts), "cell", salt).sortWithinPartitions("cell", salt)
    blocks = _packed(dealt, BLOCK, None).select("cell", F.col("pack").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.explode(F.sequence(F.lit(0), of_cell - 1)).alias("slot"))
    # Blocks are as many times larger as there are slots than they are thought to be when a join is planned, so they must
    # never be broadcast. A merge join holds one slot's chunks, SLOT_CHUNKS or so, and lets its blocks pass.
    met = blocks.join(chunks.hint("merge"), ["cell", "slot"]).select("ids", "vectors", "codes", "query_ids", "query_vectors", "slot", "block")
    shared = spark.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last, block = shared.value, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[n].as_py(), np.int64)
                x = np.frombuffer(batch.column(1)[n].as_py(), np.float64).reshape(-1, coder.dims)
                codes = np.frombuffer(batch.column(2)[n].as_py(), np.uint8).reshape(len(ids), -1)
                key = batch.column(5)[n].as_py(), batch.column(6)[n].as_py()
                if key != last:
                    if block is not None:
                        yield block.rows()
                    last, block = key, _Block(np.frombuffer(batch.column(3)[n].as_py(), np.int64), np.frombuffer(batch.column(4)[n].as_py(), np.float64).reshape(-1, coder.dims), k)
                places = max(4 * k + 4, int(len(ids) * rerank))
                rows = leading(ids, x, k)
                ids, x = ids[rows], x[rows]
                codes, code = np.unique(codes[rows], axis=0, return_inverse=True)
                code = code.reshape(-1)
                for start in range(0, len(block.ids), 256):
                    part, part_ids = block.vectors[start : start + 256], block.ids[start : start + 256]
                    score = scan(coder.tables(part), codes)
                    cut = -np.partition(-score, places - 1, axis=1)[:, places - 1 : places] if places < len(codes) else -np.inf
                    score = score[:, code]
                    most = int((score >= cut).sum(1).max())
                    # Many rows of one code are met by fewer queries at once.
                    step = max(1, 256 * places // most)
                    for own in (slice(n, n + step) for n in range(0, len(part), step)):
                        best = np.argpartition(-score[own], most - 1, axis=1)[:, :most] if most < len(ids) else np.tile(np.arange(len(ids)), (len(part[own]), 1))
                        exact = cosines(part[own], x, best)
                        exact[ids[best] == part_ids[own, None]] = -np.inf
                        block.meet(start + own.start, ids[best], exact)
        if block is not None:
            yield block.rows()

    found = map_batches(met, run, kinds)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class _Block:
    """Queries of a block and the k nearest of the rows that they have met in a slot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found, self.top = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)

    def meet(self, start: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows ``ids`` with their scores for the queries from ``start`` on; ties go to the smaller id."""
        own = slice(start, start + len(ids))
        ids, scores = np.hstack([self.found[own], ids]), np.hstack([self.top[own], scores])
        order = np.lexsort((ids, -scores))[:, : self.k]
        self.found[own], self.top[own] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self) -> pa.RecordBatch:
        # Tells queries of one id apart, whichever block or attempt they come from.
        names = np.array([xxhash.xxh64_intdigest((v + 0.0).tobytes()) for v in self.vectors], np.uint64).view(np.int64)
        real = self.top > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, real.sum(1))), pa.array(np.repeat(names, real.sum(1))), pa.array(self.found[real]), pa.array(self.top[real])], ["query_id", "query", "vec_id", "score"])


def leading(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any query: of equal vectors those with the smallest ids.

    A query's own id is no neighbour, so beside k rows as many stay as one id has among these vectors.
    """
    # Adding 0.0 makes -0.0 and 0.0 equal bytes.
    keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).reshape(-1)
    _, kind = np.unique(keys, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.lexsort((ids, kind))
    kinds, sorted_ids, at = kind[order], ids[order], np.arange(len(ids))
    new_kind = np.r_[True, kinds[1:] != kinds[:-1]]
    new_id = new_kind | np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]
    starts = np.flatnonzero(new_id)
    most = np.zeros(kinds.max() + 1, int)
    np.maximum.at(most, kinds[starts], np.diff(np.r_[starts, len(ids)]))
    rank = at - np.flatnonzero(new_kind)[kinds]
    return np.sort(order[rank < k + most[kinds]])


def cosines(queries: np.ndarray, vectors: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Cosines of each query and its picked vectors in double precision; extreme magnitudes are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        squares = [(v * v).sum(1) for v in (queries, vectors)]
    if any(s.size and (s.min() < 1e-200 or s.max() > 1e200) for s in squares):
        queries, vectors = (v / np.abs(v).max(1, keepdims=True) for v in (queries, vectors))
        squares = [(v * v).sum(1) for v in (queries, vectors)]
    dots = np.einsum("qd,qnd->qn", queries, vectors[picked])
    return dots / (np.sqrt(squares[0])[:, None] * np.sqrt(squares[1])[picked])
