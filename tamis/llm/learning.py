"""Labelled samples, and the small models that are fitted on the driver from bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, materialise, text_of

#: Labelled rows that a classifier is fitted on at most (a documented bound; scoring covers every row).
SAMPLE = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE) -> DataFrame:
    """(text, label, apart) of at most ``limit`` labelled rows, chosen by a hash of their id and written once.

    ``allowed`` says by doc_id which rows may be learnt from; ``apart`` is true for a quarter of the ids. Null
    labels and ids are left out; an id with several labels counts as positive if one of them is, and an id with
    several rows gives one, the one with the smallest text hash.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(allowed)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")  # ids: at most ``limit``
    one = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialise(one.select("text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0).alias("apart")))


def matrix(sample: DataFrame, features: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ``apart`` of a bounded sample, in an order that does not depend on the partitions."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "label", "apart"])

    rows = sample.select("text", "label", "apart").mapInArrow(run, "x array<double>, label int, apart boolean").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0, bool)
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    y, apart = rows["label"].to_numpy().astype(float), rows["apart"].to_numpy()
    order = np.lexsort((*x.T[::-1], y, apart))
    return x[order], y[order], apart[order]


def scored(df: DataFrame, held_out: Column, score: Callable[[list[str]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text counts as empty."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(np.asarray(score([t.as_py() for t in b.column(2)]), float), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


class Boosted:
    """Gradient-boosted trees on binned features, logistic loss, with isotonic calibration."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0) -> None:
        self.trees_wanted, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, cut and value of each node of a full tree
        self.base = 0.0
        self.knots = (np.array([0.0]), np.array([0.5]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def _margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
            out += value[node]
        return out

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        inner, total = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, self.bins), np.zeros(total)
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best, local = np.full(width, 1e-6), node - first
            for j in range(b.shape[1]):
                slot = local * (self.bins + 1) + b[:, j]
                gs = np.bincount(slot, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(slot, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better], cut[first : first + width][better] = j, top[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        value[inner:] = self.rate * gs / (hs + 1)
        self.trees.append((feature, cut, value))

    def fit(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Boosted:
        """Rows that are not ``apart`` grow the trees, the others calibrate them; all do both where one part lacks a label."""
        if not len(y) or y.min() == y.max():  # nothing to tell apart
            self.knots = (np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.0]))
            return self
        grow = ~apart
        if len({*y[apart]}) < 2 or len({*y[grow]}) < 2:
            apart = grow = np.ones(len(y), bool)
        self.cuts = [np.unique(np.quantile(x[grow, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.bins = max(map(len, self.cuts)) + 1
        b = self._binned(x)
        p = y[grow].mean()
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(grow.sum(), self.base)
        for _ in range(self.trees_wanted):
            q = 1 / (1 + np.exp(-margin))
            self._tree(b[grow], y[grow] - q, q * (1 - q))
            feature, cut, value = self.trees[-1]
            node = np.zeros(len(margin), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[grow][np.arange(len(margin)), feature[node]] > cut[node])
            margin += value[node]
        self.knots = isotonic(self._margin(b[apart]), y[apart])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = self._margin(self._binned(x)) if self.trees else np.zeros(len(x))
        return np.interp(margin, *self.knots)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising curve from margin to probability. Rows of equal margin are one point."""
    points, of = np.unique(margin, return_inverse=True)
    rows, hits = np.bincount(of, minlength=len(points)), np.bincount(of, y, len(points))
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, n, v in zip(points.tolist(), rows.tolist(), hits.tolist(), strict=True):
        blocks.append([v, n, m * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last, strict=True)]
    return np.array([m / n for _, n, m in blocks]), np.array([v / n for v, n, _ in blocks])
