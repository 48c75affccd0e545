"""Hierarchical language identification.

A text's family is chosen first, by one-versus-one linear support vector machines between families; the
language within the family is then chosen by one-versus-one machines that were trained on that family's
languages alone. Features are the relative frequencies of hashed letter pairs and triples over the whole
text, runs of other characters counting as one blank.

The machines are fitted on a bounded sample: at most ``per_language`` texts of each label and ``total`` texts
together, those with the smallest hash of their id and text; of more than ``total`` labels the most frequent ones
are learned (ties: the first in alphabetical order). Everything else covers all rows.

Results: a text that is null or has no letter is ``und`` with score 0. With one label that label is
predicted; with none every text is ``und``. Equal votes go to the label with the larger summed margin,
then to the first in alphabetical order. Repeated rows give repeated results. Other columns pass through;
those named ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import crc_fold, map_batches

UNKNOWN = "und"
#: Hashed features of each order.
BUCKETS = 2048
PER_LANGUAGE, TOTAL = 400, 4000
#: Language codes by family. A code that is missing here is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
}


def family_of(label: str, families: dict[str, str]) -> str:
    code = label.split("-")[0].split("_")[0].lower()
    return next((name for name, codes in families.items() if code in codes.split()), f"own:{label}")


_LOWER: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    """The lower-case code point of every letter, 0 for what is no letter."""
    if not _LOWER:
        out = np.zeros(0x110000, np.uint32)
        for point in range(0x110000):
            if (char := chr(point)).isalpha():
                low = char.lower()
                out[point] = ord(low[0])
        _LOWER.append(out)
    return _LOWER[0]


def grams(text: str) -> np.ndarray | None:
    """Feature numbers of a text's letter pairs and triples; None without a letter."""
    points = _lower_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not points.any():
        return None
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = points
    kept = padded[np.concatenate(([True], (padded[1:] != 0) | (padded[:-1] != 0)))]
    first, second = kept[:-1] * np.uint32(0x9E3779B1), kept[1:] * np.uint32(0x85EBCA6B)
    pairs = first ^ (second >> np.uint32(5))
    triples = (pairs[:-1] * np.uint32(0xC2B2AE35)) ^ (kept[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate(((pairs * np.uint32(0x2545F491)) >> shift, ((triples * np.uint32(0x2545F491)) >> shift) + np.uint32(BUCKETS)))


def frequencies(text: str) -> np.ndarray | None:
    found = grams(text)
    if found is None:
        return None
    counts = np.bincount(found, minlength=2 * BUCKETS).astype(np.float64)
    counts[:BUCKETS] /= max(counts[:BUCKETS].sum(), 1)
    counts[BUCKETS:] /= max(counts[BUCKETS:].sum(), 1)
    return counts


@dataclass
class Model:
    labels: list[str] = field(default_factory=list)
    family: dict[str, str] = field(default_factory=dict)
    scale: np.ndarray | None = None
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, x: np.ndarray, names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, margins, odds = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}
        for a, b in combinations(names, 2):
            w = machines[a, b]
            margin = float(x @ w[:-1] + w[-1])
            votes[a if margin >= 0 else b] += 1
            margins[a] += margin
            margins[b] -= margin
            odds[a, b] = 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
        best = min(names, key=lambda n: (-votes[n], -margins[n], n))
        sure = min(p if a == best else 1 - p for (a, b), p in odds.items() if best in (a, b))
        return best, float(sure)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = frequencies(text) if text and self.labels else None
        if x is None:
            return UNKNOWN, 0.0
        x = x * self.scale
        families = sorted(set(self.family.values()))
        name, p = self._vote(x, families, self.between)
        label, q = self._vote(x, sorted(k for k, v in self.family.items() if v == name), self.within)
        return label, float(min(1.0, max(0.0, p * q)))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; y is 1 or -1, the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, norms, order = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(labels: list[str], x: np.ndarray, families: dict[str, str] = FAMILIES) -> Model:
    names = sorted(set(labels))
    model = Model(names, {n: family_of(n, families) for n in names})
    if not names:
        return model
    spread = x.std(0)
    model.scale = np.where(spread > 0, 1 / (np.sqrt(x.shape[1]) * (spread + 1e-4)), 0.0)
    x = x * model.scale
    own, of = np.array(labels), np.array([model.family[n] for n in labels])
    for a, b in combinations(sorted(set(of)), 2):
        rows = (of == a) | (of == b)
        model.between[a, b] = fit_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))
    for a, b in combinations(names, 2):
        if model.family[a] == model.family[b]:
            rows = (own == a) | (own == b)
            model.within[a, b] = fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0))
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL, families: dict[str, str] = FAMILIES) -> Model:
    """Fit on labelled rows ``(doc_id, text, lang)``; rows without text or label teach nothing.

    Features are made on the executors, and at most ``total`` rows of them reach the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total).collect())
    each = max(1, min(per_language, total // max(1, len(counts))))
    if not counts:
        return Model()
    # About twice the rows wanted, by a hash of the id; then exactly those with the smallest hashes.
    part = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, (2 * each + 50) / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = rows.withColumn("draw", draw).where(F.col("draw") <= part[F.col("lang")])
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("n") <= each)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(lang, f) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (f := frequencies(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1].astype(np.float32).tobytes() for p in pairs], pa.binary())], ["lang", "x"])

    found = sorted((r.lang, bytes(r.x)) for r in map_batches(ranked.select("lang", "text"), features, "lang string, x binary").collect())
    x = np.array([np.frombuffer(b, np.float32) for _, b in found], np.float64).reshape(len(found), 2 * BUCKETS)
    return fit([lang for lang, _ in found], x, families)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``. The model's size is bounded by labels and buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n not in ("lang_pred", "score")]
    rows = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(text.as_py()) for text in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(rows, run, rows._jdf.schema().toDDL() + ", lang_pred string, score double")


def held_out(column: str = "doc_id", folds: int = 5):
    return crc_fold(column, folds) == 0
