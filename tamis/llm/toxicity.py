"""Toxicity by gradient-boosted trees on dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, id_remainder
from tamis.llm.learning import SAMPLE, Boosted, labelled_sample, matrix, scored

WORD = re.compile(r"[^\W_]+(?:[@$*!0-9]+[^\W_]+)*")
HIDDEN = re.compile(r"[^\W\d_][@$*!0-9]+[^\W\d_]")
#: Letters and digits, and capitals, by code point.
ALNUM, UPPER = (np.array([f(chr(c)) for c in range(0x10000)]) for f in (str.isalnum, str.isupper))
#: Fixed value: digits and signs that stand for letters.
PLAIN = str.maketrans("013457@$!", "oieastasi")
#: Fixed value: second-person words of the languages at hand.
YOU = frozenset("you your yours yourself u du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
#: Words whose weight is remembered.
REMEMBER = 300_000
#: Stem lengths that the lexicon learns beside whole words; toxic documents of the sample an entry is in at least, and its log-odds (fewer are chance); words that count as near.
STEMS, LEAST, ODDS, NEAR = (4, 5, 6), 4, 1.5, 5


def stems(word: str) -> list[str]:
    return [word[:k] + "-" for k in STEMS if len(word) >= k] + [word]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """All stems and words that tell toxic from other documents, with their log-odds, from the rows of a bounded sample that are not apart."""
    bounded_batches(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = {s for w in set(WORD.findall(text.as_py().lower())) for s in stems(w)}
                seen.update((s, int(label > 0)) for s in own)
                seen["", int(label > 0)] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["stem", "label", "n"])

    counts = sample.where("not apart").select("text", "label").mapInArrow(count, "stem string, label int, n long")
    by = counts.groupBy("stem").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(label = 0, n, 0)")).alias("neg"))
    totals = by.where("stem = ''").first()
    if not totals or not totals["pos"] or not totals["neg"]:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (totals["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (totals["neg"] + 1.0))
    rows = by.where(f"stem <> '' and pos >= {LEAST}").withColumn("odds", odds).where(F.col("odds") > ODDS).orderBy("stem").collect()  # words of the sample
    return {r["stem"]: r["odds"] for r in rows}


class Weights(dict):
    """Strength of each word and whether only its plain spelling is in the lexicon; frequent words are remembered."""

    NOTHING = (0.0, False)

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def of(self, word: str) -> float:
        return max([self.lexicon.get(s, 0.0) for s in stems(word)])

    def __missing__(self, word: str) -> tuple[float, bool]:
        weight = self.of(word)
        plain = 0.0 if word.isalpha() else self.of(word.translate(PLAIN))
        found = (max(weight, plain), not weight and plain > 0) if weight or plain else self.NOTHING
        if len(self) < REMEMBER:
            self[word] = found
        return found


class Features:
    """Dense features of a text, given the lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.weights = Weights(lexicon)

    def __getstate__(self) -> dict[str, float]:
        return self.weights.lexicon

    def __setstate__(self, lexicon: dict[str, float]) -> None:
        self.weights = Weights(lexicon)

    def __call__(self, text: str) -> list[float]:
        words = WORD.findall(text)
        lower = [w.lower() for w in words]
        n, chars = max(1, len(words)), max(1, len(text))
        found = [self.weights[w] for w in lower]
        hits = [i for i, f in enumerate(found) if f is not Weights.NOTHING]
        strength = [found[i][0] for i in hits]
        you = np.array([i for i, w in enumerate(lower) if w in YOU])
        near = 0
        if hits and len(you):  # distance to the nearest second-person word on either side
            at = np.searchsorted(you, hits)
            before = np.where(at > 0, np.array(hits) - you[np.maximum(at - 1, 0)], NEAR + 1)
            after = np.where(at < len(you), you[np.minimum(at, len(you) - 1)] - np.array(hits), NEAR + 1)
            near = int((np.minimum(before, after) <= NEAR).sum())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = ALNUM[np.minimum(codes, len(ALNUM) - 1)]
        drawn = int(((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & letters[2:]).sum()) if len(codes) > 2 else 0
        strong = sum(s > 3 for s in strength)
        return [
            len(hits) / n, float(np.log1p(len(hits))), sum(strength) / n, max(strength, default=0.0), float(len({lower[i] for i in hits})),
            strong / n, float(np.log1p(strong)), near / n, float(np.log1p(near)), len(you) / n,
            float(UPPER[np.minimum(codes, len(UPPER) - 1)].sum()) / chars, sum(w.isupper() and len(w) > 1 for w in words) / n,
            text.count("!") / chars, text.count("?") / chars, sum(map(text.count, ".,;:#$%&*|")) / chars,
            sum(not w.isalpha() and HIDDEN.search(w) is not None for w in lower) / n, drawn / n, sum(found[i][1] for i in hits) / n,
            float(np.log1p(n)), n / chars,
        ]


def held_out(name: str = "doc_id") -> Column:
    return id_remainder(name, 5) == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Lexicon and trees are learnt from three quarters of at most ``limit`` labelled rows, the
    calibration from the rest.
    Defined cases: null and empty texts get the score of the empty text; repeated rows
    a row each; null ids pass; without labels of both kinds every score is the share
    of toxic labels seen (0 if none); an empty table gives an empty result.
    """
    sample = labelled_sample(docs, labels, "toxic", ~held_out(), limit)
    features = Features(learn_lexicon(sample))
    model = Boosted().fit(*matrix(sample, features))
    return scored(docs, held_out(), lambda texts: model.predict(np.array([features(t) for t in texts], float)) if texts else np.zeros(0))
