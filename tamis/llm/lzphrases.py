"""Lempel-Ziv phrase fingerprints.

A text is parsed once from the left into phrases, each the longest known phrase
and one character more (the edited text carries on from the middle); the set of
phrases is hashed and the smallest hashes make the fingerprint. The share of common values among the smallest of both
estimates the likeness of two phrase sets, which behaves like a compression
distance: shared passages parse into shared phrases.

Neighbours in descending id order are found with one shuffle of the texts:
splitters from quantiles of the ids cut them in ranges, the row at each splitter
is also sent to the range above it, and a task walks through its sorted rows
with one row of look-ahead. An id (or null) that holds much of the rows shows as a
repeated quantile; then its equal texts become one row with a count, and its
different texts are cut into ranges by their hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, materialise, text_of

#: Hashes kept of a text, each of 32 bits; rows of a batch of equal ones.
KEPT, REPEATED = 64, 10_000
#: Fixed value: an odd multiplier for the rolling hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def parse(text: str, known: set[str] | frozenset[str] = frozenset(), word: str = "") -> tuple[list[str], str]:
    """Phrases of ``text`` in order, beside those ``known`` before, and the part of a phrase that is left.

    ``word`` is what was left of the text before; the left part is always a known phrase.
    """
    own: set[str] = set()
    add, out = own.add, []
    for c in text:
        word += c
        if word not in own and word not in known:
            add(word)
            out.append(word)
            word = ""
    return out, word


def hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hashes of phrases."""
    if not phrases:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    e = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    s = np.r_[0, e[:-1]]
    with np.errstate(over="ignore"):
        power = powers(len(codes))
        sums = np.r_[np.uint64(0), np.cumsum(codes * power[0][: len(codes)], dtype=np.uint64)]
        h = (sums[e] - sums[s]) * power[1][s] + (e - s).astype(np.uint64)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(32)).astype(np.uint32)


def smallest(h: np.ndarray) -> np.ndarray:
    """The KEPT smallest different values, ascending."""
    if len(h) > 4 * KEPT:
        part = np.unique(np.partition(h, 2 * KEPT)[: 2 * KEPT])
        if len(part) >= KEPT:
            return part[:KEPT]
    return np.unique(h)[:KEPT]


def signature(text: str) -> np.ndarray:
    """Fingerprint of a text: the smallest hashes of its phrases."""
    return smallest(hashes(parse(text)[0]))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first powers of BASE and of its inverse; those of usual lengths are kept."""
    if len(_powers[0]) >= n:
        return _powers
    size = 1 << max(12, (n - 1).bit_length())
    with np.errstate(over="ignore"):
        both = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE)]
    if size <= 1 << 20:
        _powers[:] = both
    return both


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of phrases in common; two empty texts are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    one, two = set(a.tolist()), set(b.tolist())
    both = sorted(one | two)[:KEPT]
    return len(one & two & set(both)) / len(both)


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


#: The ends of a long.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _range_of(key: Column, turned: Column, splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters below (key, turned), by binary search."""
    if not splitters:
        return F.lit(0)
    keys, hashes_ = _longs([k for k, _ in splitters]), _longs([h for _, h in splitters])
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (F.get(keys, mid) < key) | (F.get(keys, mid) == key) & (F.get(hashes_, mid) < turned)
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length() + 1)), state, step)["lo"]


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next text in descending id order; the first follows the last.
    Defined cases: null text counts as empty; null ids come last; rows with equal
    ids follow each other by the hash of their texts; a lone row is its own
    neighbour; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), key.alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.agg(F.percentile_approx("key", at, 100 * parts).alias("cuts"), F.max("key").alias("top")).first()
    times = Counter(cuts["cuts"] or []) if parts > 1 else Counter()
    hot = sorted(k for k, n in times.items() if n > 1)  # ids with more rows than a range should have
    # Rows in descending order of (key, turned); turned is the complement of the text's hash where ids are hot.
    splitters = [(k, HIGHEST) for k in times if k != cuts["top"]]
    if hot:
        equal = rows.where(F.col("key").isin(hot)).groupBy("doc_id", "text", "key").agg(F.count("*").alias("n"))
        others = rows.where(~F.col("key").isin(hot)).withColumn("n", F.lit(1).cast("long"))
        rows = materialise(others.unionByName(equal).withColumn("turned", F.bitwise_not(F.xxhash64("text"))))
        splitters += [(k, LOWEST + (1 << 64) * i // times[k]) for k in hot for i in range(1, times[k])]
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long")).withColumn("turned", F.lit(HIGHEST))
    splitters.sort()
    # Range r holds what is above splitter r - 1 up to splitter r; its first row follows the last of the next range that has any.
    ranged = rows.withColumn("own", _range_of(F.col("key"), F.col("turned"), splitters).cast("int"))
    if hot:
        tops = {r["own"]: (r["top"]["key"], r["top"]["turned"]) for r in ranged.groupBy("own").agg(F.max(F.struct("key", "turned")).alias("top")).collect()}
    else:  # splitters are ids of rows
        tops = dict(enumerate([*splitters, (cuts["top"], HIGHEST)])) if cuts["top"] is not None else {}
    held = sorted(tops)
    above = {r: held[(i + 1) % len(held)] for i, r in enumerate(held)}
    every = range(len(splitters) + 1)
    first = (F.col("key") == F.get(_longs([tops.get(r, (0, 0))[0] for r in every]), F.col("own"))) & (F.col("turned") == F.get(_longs([tops.get(r, (0, 0))[1] for r in every]), F.col("own")))
    guest = F.when(first, F.get(F.array(*[F.lit(above.get(r, 0)) for r in every]), F.col("own")))
    targets = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(guest.alias("range"), F.lit(True).alias("guest")))
    placed = ranged.withColumn("to", F.explode(F.filter(targets, lambda t: t["range"].isNotNull())))
    placed = placed.select("doc_id", "text", "key", "n", F.col("to.range").cast("int").alias("range"), F.col("to.guest").alias("guest"))
    dealt = placed.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions("guest", F.col("key").desc(), F.xxhash64("text"), "text")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # id, text, whether a guest, phrases of the first half, signature

        def opened(doc: int | None, text: str, guest: bool) -> tuple:
            middle = len(text) - len(text) // 2
            first, left = parse(text[:middle])
            known, head = frozenset(first), hashes(first)
            rest, _ = parse(text[middle:], known, left)
            return doc, text, guest, (known, left, head), smallest(np.concatenate([head, hashes(rest)]))

        def close(a: tuple, b: tuple) -> None:
            doc, text, _, (known, left, head), sig = a
            half = len(text) // 2
            added = b[1][:half]
            edited = text[: len(text) - half] + added
            other = smallest(np.concatenate([head, hashes(parse(added, known, left)[0])]))
            digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            out.append((doc, len(text), digest, shown(sig), shown(other), likeness(sig, other), likeness(sig, b[4])))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

        def repeated(row: tuple, n: int) -> Iterator[pa.RecordBatch]:
            for i in range(0, n, REPEATED):
                yield batch([row] * min(REPEATED, n - i))

        for b in batches:
            for doc, text, guest, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last is not None and last[2]:
                    break  # further guests
                now = opened(doc, text.as_py(), guest)
                if last is not None:
                    close(last, now)
                if n > 1 and not guest:  # rows with the same id and text follow each other
                    close(now, now)
                    yield from repeated(out.pop(), n - 1)
                last = now
            if out:
                yield batch(out)
                out.clear()

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "guest", "n").mapInArrow(walk, kinds)
