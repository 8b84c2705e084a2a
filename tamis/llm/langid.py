"""Language identification with bit-sliced Bloom filters.

Each slot of the filter holds a mask with one bit a language, so one look-up of
an n-gram (the masks at its slots, combined by AND) returns all languages whose
filter has it. Set bits are counted for each language over the text's n-grams
and corrected for the share of false positives that the filter's fill implies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, id_remainder, text_of

#: Documents of a language learnt from, about, at most; every n-gram of them goes into the filter.
SAMPLE = 3_000
#: Length of n-grams, hashes of an n-gram, and slots of the filter for each n-gram of the largest language (rounded up to a power of two).
LENGTH, HASHES, ROOM = 4, 3, 12
#: Bits of a mask.
LANGUAGES = 64
#: Odd multipliers.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _folded() -> np.ndarray:
    """Lower-case code of each letter of the basic plane, 32 for anything else."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of letters and single blanks; empty if the text has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = _folded()[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        folded = folded.copy()
        for c in np.unique(codes[high]).tolist():
            folded[codes == c] = c if chr(c).isalpha() else 32
    letters = folded != 32
    if not letters.any():
        return np.zeros(0, np.uint64)
    padded = np.r_[np.uint32(32), folded, np.uint32(32)]
    padded = padded[np.r_[True, (padded[1:] != 32) | (padded[:-1] != 32)]].astype(np.uint64)
    if len(padded) < LENGTH:
        padded = np.r_[padded, np.full(LENGTH - len(padded), 32, np.uint64)]
    n = len(padded) - LENGTH + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(LENGTH):
            h = (h ^ padded[k : k + n]) * MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
    return h


def slots(h: np.ndarray, size: int) -> np.ndarray:
    """(HASHES, n) slots of n-grams in a filter of ``size``, a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)])


class MaskFilters:
    """The filters of all languages in one array of masks."""

    def __init__(self, of: dict[str, np.ndarray]) -> None:
        self.langs = sorted(of)
        self.size = 1 << int(ROOM * max([1 << 10, *map(len, of.values())])).bit_length()
        self.masks = np.zeros(self.size, np.min_scalar_type((1 << max(1, len(self.langs))) - 1))
        for bit, lang in enumerate(self.langs):
            at = slots(of[lang], self.size).ravel()
            self.masks[at] |= self.masks.dtype.type(1 << bit)
        fill = np.array([np.count_nonzero(self.masks >> self.masks.dtype.type(b) & self.masks.dtype.type(1)) for b in range(len(self.langs))]) / self.size
        self.false = fill**HASHES

    def identify(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the corrected counts; ``und`` with score 0 for a text without letters.

        Of equal counts, and so of none at all, the first language by name.
        """
        h = grams(text or "")
        if not len(h) or not self.langs:
            return "und", 0.0
        at = slots(h, self.size)
        found = self.masks[at[0]]
        for k in range(1, HASHES):
            found = found & self.masks[at[k]]
        one = found.dtype.type(1)
        hits = np.array([np.count_nonzero(found >> found.dtype.type(b) & one) for b in range(len(self.langs))])
        fair = np.maximum(0.0, (hits - len(h) * self.false) / (1 - self.false))
        best = int(fair.argmax())
        return self.langs[best], float(fair[best] / fair.sum()) if fair.sum() > 0 else 0.0


def learn(docs: DataFrame, allowed: Column, limit: int = SAMPLE) -> MaskFilters:
    """Filters from about ``limit`` rows of each language (all, if it has fewer), chosen by a hash of their id.

    Two passes whatever the number of languages: one counts their rows, one gathers the n-grams.
    Rows with null ids are not learnt from.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(allowed)
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"a mask has {LANGUAGES} bits: learn from at most {LANGUAGES} languages")
    if not found:
        return MaskFilters({})
    share = F.create_map(*[F.lit(v) for r in found for v in (r["lang"], int(min(1.0, limit / r["n"]) * (1 << 30)))])
    near = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")]).select("doc_id", text_of().alias("text"), "lang")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                keys = np.unique(np.concatenate([grams(t.as_py()) for t, l in zip(b.column(0), langs, strict=True) if l == lang]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64))], ["lang", "gram"])

    table = near.select("text", "lang").mapInArrow(known, "lang string, gram long").distinct().toArrow()  # n-grams of the sample
    langs, keys = np.array(table["lang"].to_pylist()), table["gram"].to_numpy().astype(np.int64).view(np.uint64)
    return MaskFilters({r["lang"]: np.sort(keys[langs == r["lang"]]) for r in found})


def held_out(name: str = "doc_id") -> Column:
    return id_remainder(name, 5) == 0


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Defined cases: null, empty and letterless texts are ``und`` with score 0; so is
    everything if nothing could be learnt; of languages with equal counts, as when no
    n-gram is known, the first by name (with score 0 if all counts are 0); repeated
    rows a row each; null ids pass; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs, ~held_out()))  # as large as the sample's n-grams
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [filters.value.identify(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
