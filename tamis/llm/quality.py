"""Quality by Bradley-Terry pairwise ranking.

Documents of either label make preference pairs; logistic loss on the
difference of their features learns a score, and a quantile of the scores, the
share of rejected documents among the labelled ones, is the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import bounded_batches, id_remainder
from tamis.llm.learning import SAMPLE, labelled_sample, matrix, scored

#: Pairs that each labelled document is drawn into, and the strength of the penalty.
PAIRS, PENALTY = 4, 1e-3
#: Standard deviations that a feature approaches and never passes.
BEND = 8.0
MARKS = "#$%&*!|.,?:;-_/<>=@\"'()+~^[]{}\\"
_CLASS = np.full(0x250, 5, np.int64)  # five: other letters and signs
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 6 + MARKS.index(_s) if _s in MARKS else 0 if _s == "\n" else 1 if _s.isspace() else 2 if _s.isdigit() else 3 if _s.isupper() else 4 if _s.islower() else 5
CLASSES = 6 + len(MARKS)


def features(text: str) -> list[float]:
    """Dense features of a whole text; the empty text has a vector too."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = max(1, len(codes))
    shares = np.bincount(_CLASS[np.minimum(codes, 0x24F)], minlength=CLASSES) / n
    words = text.split()
    count = max(1, len(words))
    lower = [w.lower() for w in words]
    distinct = len(set(lower))
    same = sum(a == b for a, b in pairwise(lower))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    ended = sum(w[-1] in MARKS for w in words) / count
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / count
    lines = text.split("\n")
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    marks = shares[6:]
    return [
        *shares.tolist(),
        *np.sqrt(marks).tolist(),
        float(np.log1p(len(codes))), float(np.log1p(len(words))), distinct / count, float(np.log1p(distinct)), same / count, float(same > 2),
        float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), ended, capitals, float(capitals > 0.2),
        len(set(lines)) / len(lines), float(np.log1p(len(lines))), float(np.log1p(len(text) / len(lines))),
        float(np.log1p(packed)), float(packed < 0.25), float(marks.sum()), float(marks.max()), float(np.log1p(1000 * marks[:7].sum())),
    ]


class Ranking:
    """score(x) = sigmoid(sharpness * (w.x - threshold))."""

    def __init__(self) -> None:
        self.mean = self.scale = self.w = np.zeros(0)
        self.threshold, self.sharpness, self.constant = 0.0, 1.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ranking:
        good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
        if not len(good) or not len(bad):  # no pair: everything keeps the only label seen
            self.constant = 1.0 if len(good) or not len(y) else 0.0
            return self
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._standard(x)
        rng = np.random.default_rng(0)
        a = np.concatenate([np.tile(good, PAIRS), rng.choice(good, PAIRS * len(bad))])
        b = np.concatenate([rng.choice(bad, PAIRS * len(good)), np.tile(bad, PAIRS)])
        d = z[a] - z[b]
        w = np.zeros(d.shape[1])
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            slope = d.T @ (1 - p) / len(d) - PENALTY * w
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        s = np.sort(z @ w)
        k = len(bad)  # as many below the threshold as are labelled 0
        self.threshold = float((s[k - 1] + s[k]) / 2)
        self.sharpness = 1.0
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        """Deviations from the mean, bent towards a bound by one rising curve."""
        return BEND * np.tanh((x - self.mean) / self.scale / BEND)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(x), self.constant)
        s = self._standard(x) @ self.w - self.threshold
        return 1 / (1 + np.exp(-np.clip(self.sharpness * s, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = SAMPLE) -> Ranking:
    """Fit on at most ``limit`` labelled rows that ``allowed`` lets through."""
    return Ranking().fit(*matrix(labelled_sample(docs, labels, "quality", allowed, limit), features)[:2])


def held_out(name: str = "doc_id") -> Column:
    return id_remainder(name, 3) == 1


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Defined cases: null and empty texts get the score of the empty text; repeated
    rows a row each; null ids pass; without labels of both kinds every text gets the
    label seen (1 if none); an empty table gives an empty result.
    """
    model = learn(docs, labels, ~held_out())
    return scored(docs, held_out(), lambda texts: model.predict(np.array([features(t) for t in texts], float)) if texts else np.zeros(0))


def drop_rejected(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns. Each row is judged by its own text, in one pass."""
    model = learn(docs, labels, ~held_out())
    bounded_batches(docs.sparkSession)
    flagged = T.StructType([*docs.schema.fields, T.StructField("__kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py() or "") for t in b.column(b.schema.get_field_index(text_col))]
            kept = model.predict(np.array(rows, float)) >= 0.5 if rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept)], [*b.schema.names, "__kept"])

    return docs.mapInArrow(run, flagged).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
