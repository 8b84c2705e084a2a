"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, components.

Distinct fingerprints are the nodes, so exact copies cost one row. Six bit
blocks, of which two fingerprints within the radius of 4 share at least two,
give fifteen exact keys; rows of a key are compared with each other. A key with
more rows than ``CHUNK`` is cut in chunks, and every pair of chunks is a group
of its own, so no task holds an unbounded group and no pair is left out.

Inside a task the bits of all fingerprints lie vertically (one plane a bit, one
lane a fingerprint). For each distance d between neighbours in key order, the
planes of lane i and i + d are combined and counted in carry-save counters;
words of 64 lanes that are all over the radius are given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, join_hot, materialise
from tamis.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: First bit and width of each block; RADIUS + 2 blocks, so two agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BANDS = tuple(combinations(range(len(BLOCKS)), 2))
#: Rows of a key from which it is cut, and hashes unpacked at a time.
CHUNK, HASHES = 2048, 16384


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a UTF-8 text; null and wordless texts give zero."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[WORDS - 1 :] or ends[-1:]
    xx = xxhash.xxh64_intdigest
    hashes = np.array([xx(joined[s : e - 1], SEED) for s, e in zip(starts, last, strict=False)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        ones += np.unpackbits(hashes[i : i + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def within_radius(fps: np.ndarray, left: np.ndarray, right: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which lanes i have fps[left[i]] and fps[right[i]] at ``radius`` (at most 6) or fewer bits.

    planes: (64, n) bytes, the bits of fps laid vertically.
    """
    words = -(-len(left) // 64)
    ones, twos, fours, over = (np.zeros(words, np.uint64) for _ in range(4))
    live = np.arange(words)
    result = np.full(words, ~np.uint64(0))
    for first in range(0, 64, 8):
        if first == 0:
            l, r = left, right
        else:
            lanes = (live[:, None] * 64 + np.arange(64)).ravel()
            lanes = lanes[lanes < len(left)]
            l, r = left[lanes], right[lanes]
        diff = planes[first : first + 8, l] ^ planes[first : first + 8, r]
        packed = np.zeros((8, len(live) * 8), np.uint8)
        bits = np.packbits(diff, axis=1, bitorder="little")
        packed[:, : bits.shape[1]] = bits
        for x in packed.view("<u8"):
            carry = ones & x
            ones = ones ^ x
            more = twos & carry
            twos = twos ^ carry
            over |= fours & more
            fours = fours ^ more
        # fours, twos, ones spell the count; over stays set from eight on.
        beyond = over.copy()
        for count in range(radius + 1, 8):
            beyond |= (fours if count & 4 else ~fours) & (twos if count & 2 else ~twos) & (ones if count & 1 else ~ones)
        over = beyond  # a count never falls, so beyond the radius is final
        result[live] = over
        open_words = over != ~np.uint64(0)
        if not open_words.any():
            break
        live, ones, twos, fours, over = live[open_words], ones[open_words], twos[open_words], fours[open_words], over[open_words]
    return np.unpackbits(result.view(np.uint8), bitorder="little")[: len(left)] == 0


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest: as many as are needed to connect what a-b connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out_a.append(x)
            out_b.append(y)
    return out_a, out_b


def group_links(group: np.ndarray, side: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links among the pairs within the radius of each group; rows ordered by group.

    side: 0 compares with all of its group, 1 with side 2 only, 2 with side 1 only.
    """
    bits = np.ascontiguousarray(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stop = np.repeat(np.r_[edges[1:], len(group)], np.diff(np.r_[edges, len(group)]))
    lanes, found_a, found_b, d = np.arange(len(group)), [], [], 1
    while len(lanes := lanes[lanes + d < stop[lanes]]):
        use = lanes[(side[lanes] == 0) | (side[lanes] != side[lanes + d])]
        for i in range(0, len(use), 1 << 18):
            left = use[i : i + (1 << 18)]
            hit = left[within_radius(fps, left, left + d, bits)]
            found_a.append(fps[hit])
            found_b.append(fps[hit + d])
        if sum(map(len, found_a)) > 1 << 20:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [np.array(a, "<i8")], [np.array(b, "<i8")]
        d += 1
    if not found_a:
        return [], []
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within the radius."""
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS]
    keys = F.array(*[F.lit(k).cast("long") * (1 << 22) + block[i] * (1 << 11) + block[j] for k, (i, j) in enumerate(BANDS)])
    banded = nodes.select("fp", F.explode(keys).alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"))
    several = sizes.where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    placed = banded.join(several, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks").cast("long")).cast("int"))
    other = F.explode(F.expr("sequence(0, chunks - 1)"))
    tasks = placed.select("fp", "key", "own", other.alias("with")).select(
        "fp", "key",
        F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).cast("byte").alias("side"),
    )
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks.withColumn("group", F.xxhash64("key", "i", "j")).repartition(parts, "group").sortWithinPartitions("group", "key", "i", "j").select("fp", "key", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[np.ndarray]) -> pa.RecordBatch:
            fps, key, i, j, side = rows
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            a, b = group_links(np.cumsum(new), side, np.ascontiguousarray(fps))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)])
            rows += batch.num_rows
            if rows >= 1 << 16:  # whole groups go, the last one waits for the next batch
                full = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = (full[1] == full[1][-1]) & (full[2] == full[2][-1]) & (full[3] == full[3][-1])
                cut = len(last) - int(last.sum())
                if cut:
                    yield answer([c[:cut] for c in full])
                held = [[c[cut:] for c in full]]
                rows = len(last) - cut
        if rows:
            yield answer([np.concatenate(c) for c in zip(*held, strict=True)])

    return tasks.mapInArrow(compare, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, group_size of equal fingerprints.

    Defined cases: null and empty texts have fingerprint zero and link like any
    other; repeated rows keep one row each; null ids are linked but never name a
    component (null if a component has no other id); an empty table gives an empty
    result; extra columns are ignored.
    """
    prints = materialise(fingerprints(df, id_col, text_col))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes))
    rooted = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    total = rooted.agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).first()
    # A component may hold much of the nodes, a fingerprint much of the rows.
    by_print = materialise(join_hot(rooted, named, "root", total["nodes"]).select("fp", "component_id", F.col("n").alias("group_size")))
    return join_hot(prints, by_print, "fp", total["rows"] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of ``df`` for each component: the one whose id names it. Rows with a null id stay."""
    gone = simhash_components(df, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
