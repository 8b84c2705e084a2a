"""Lexical retrieval packing.

Documents become token ids once, written to the shared folder in the narrowest
integer type; the same pass counts in how many documents each term is, and puts a
bounded sample of documents aside. Before documents are dealt to shards, those that
are lexically near are brought together over the whole corpus: a tree of principal
directions, learnt from BM25 vectors of the sample, gives each document a place,
and the corpus is dealt to tasks by place, in ranges of about as many tokens each.
Then each task cuts its rows into shards of about ``SHARD`` tokens, builds a BM25
inverted index over a shard and packs it: a seed document opens a window, its best
unused neighbours by all its terms fill it, the first that doesn't fit is cut and
its rest seeds the next window. A shard's last window is cut to powers of two, so
nothing is padded.

The plan shuffles the ids once. A neighbour on the other side of a shard's border
is not found; the README has the measured recall.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.bpe import encoder
from tamis.llm.common import bounded_batches, materialise, text_of

WINDOW, SHARD = 4096, 1 << 20
#: BM25 parameters.
K1, B = 1.2, 0.75
#: A term in more than this part of a shard's documents has its list in a matrix; documents up to which all pairs are multiplied (either way the same scores).
OFTEN, PAIRED = 24, 2048
#: Order of near documents: dimensions of a vector, documents the tree is learnt from (about), sampled ones in a leaf.
DIMENSIONS, SAMPLE, LEAF = 64, 20_000, 4
#: Shards of a task, on average, and sampled documents of a task at least (so that ranges are even).
TASK_SHARDS, TASK_SAMPLE = 2, 10
#: Fixed value: an odd multiplier that scatters row numbers.
SCATTER = 0x9E3779B97F4A7C15


def _principal(x: np.ndarray) -> np.ndarray:
    """First principal direction of centred rows, by the power method from the longest row."""
    v = x[(x * x).sum(1).argmax()]
    for _ in range(12):
        v = v / max(float(np.sqrt(v @ v)), 1e-9)
        v = (x @ v) @ x
    return v / max(float(np.sqrt(v @ v)), 1e-9)


class LexicalOrder:
    """Places of documents such that those with like BM25 vectors are near each other."""

    def __init__(self, frequency: np.ndarray, documents: int, mean_length: float) -> None:
        self.idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
        self.mean_length = max(mean_length, 1.0)
        self.levels, self.directions, self.cuts, self.means = 0, np.zeros((1, DIMENSIONS), np.float32), np.zeros(1, np.float32), np.zeros((1, DIMENSIONS), np.float32)
        self._projection: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_projection": None}

    def vectors(self, ids: list[np.ndarray]) -> np.ndarray:
        """Random projections of the BM25 vectors, of length one (zero for a document without terms)."""
        if self._projection is None:
            self._projection = np.random.default_rng(0).standard_normal((len(self.idf), DIMENSIONS), np.float32)
        out = np.zeros((len(ids), DIMENSIONS), np.float32)
        for k, own in enumerate(ids):
            if len(own):
                term, count = np.unique(own, return_counts=True)
                weight = self.idf[term] * (count * (K1 + 1) / (count + K1 * (1 - B + B * len(own) / self.mean_length))).astype(np.float32)
                v = weight @ self._projection[term]
                out[k] = v / max(float(np.sqrt(v @ v)), 1e-9)
        return out

    def fit(self, sample: np.ndarray) -> LexicalOrder:
        """Split the sample at the median of its first principal direction, again and again."""
        self.levels = max(0, int(np.log2(max(1, len(sample)) / LEAF)))
        n = 1 << self.levels
        self.directions, self.cuts, self.means = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, np.float32), np.zeros((n, DIMENSIONS), np.float32)
        node = np.ones(len(sample), np.int64)  # children of k are 2 k and 2 k + 1
        for level in range(self.levels):
            for k in range(1 << level, 2 << level):
                own = sample[node == k]
                if len(own) > 1:
                    self.directions[k] = _principal(own - own.mean(0))
                    self.cuts[k] = np.median(own @ self.directions[k])
            node = self._below(node, sample)
        for k in np.unique(node - n).tolist() if self.levels else []:
            self.means[k] = sample[node - n == k].mean(0)
        return self

    def _below(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 2 * node + (np.einsum("ij,ij->i", x, self.directions[node]) > self.cuts[node])

    def places(self, x: np.ndarray) -> np.ndarray:
        """Leaf, then the signs of the first 32 coordinates relative to the leaf's mean."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.levels):
            node = self._below(node, x)
        leaf = node - (1 << self.levels)
        signs = (x - self.means[leaf])[:, :32] > 0
        return leaf << 32 | (signs.astype(np.int64) << np.arange(31, -1, -1)).sum(1)


class ShardIndex:
    """BM25 inverted index of one shard."""

    def __init__(self, ids: list[np.ndarray], frequency: np.ndarray, documents: int, mean_length: float) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        pair, count = np.unique(np.repeat(np.arange(len(ids), dtype=np.int64), lengths) << 32 | flat, return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        df = frequency[np.minimum(term, len(frequency) - 1)]
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[doc] / max(mean_length, 1.0)))
        self.n = len(ids)
        self.own = np.searchsorted(doc, np.arange(self.n + 1))  # a document's terms
        order = np.argsort(term.astype(np.min_scalar_type(int(term.max()) if len(term) else 0)), kind="stable")  # short integers sort by digits
        self.post_doc, self.post_weight = doc[order], weight[order]
        new = np.r_[True, np.diff(term[order]) > 0] if len(order) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.term = np.empty(len(order), np.int64)  # by document and term, the place of the term's list
        self.term[order] = np.cumsum(new) - 1
        self.starts, self.sizes = starts, np.diff(np.r_[starts, len(order)])
        # Lists of much of the shard lie side by side in a matrix; where the shard has few documents, all their pairs are one product.
        often = self.sizes * OFTEN > self.n
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        mine = self.column[self.term] >= 0
        held, own = self.column[self.term[mine]], doc[mine]
        self.dense = np.zeros((int(often.sum()), self.n), np.float32)
        self.dense[held, own] = weight[mine]
        self.pairs: np.ndarray | None = None
        if self.n <= PAIRED:
            has = np.zeros((self.n, len(self.dense)), np.float32)
            has[own, held] = 1
            self.pairs = has @ self.dense

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all the terms of ``doc``: frequent lists from the matrix, the others added up at once."""
        terms = self.term[self.own[doc] : self.own[doc + 1]]
        column = self.column[terms]
        rare = terms[column < 0]
        sizes = self.sizes[rare]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rare] - ends + sizes, sizes)
        out = np.bincount(self.post_doc[places], self.post_weight[places], self.n)
        return out + (self.pairs[doc] if self.pairs is not None else self.dense[column[column >= 0]].sum(0))

    def neighbours(self, doc: int) -> np.ndarray:
        """Documents that share terms with ``doc``, best first (ties: the earlier)."""
        scores = self.scores(doc)
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(lengths: np.ndarray, index: ShardIndex, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(lengths), bool)
    fresh, sequence, rest = 0, 0, None  # rest: document and start of a cut one

    while True:
        if rest is None:
            while fresh < len(used) and used[fresh]:
                fresh += 1
            if fresh == len(used):
                break
            used[fresh] = True
            rest = (fresh, 0)
        (seed, start), at = rest, 0
        take = min(window, int(lengths[seed]) - start)
        pieces.append((seed, start, take, sequence, 0))
        at, rest = take, (seed, start + take) if start + take < lengths[seed] else None
        if at < window:
            for other in index.neighbours(seed):
                if used[other]:
                    continue
                used[other] = True
                take = min(window - at, int(lengths[other]))
                pieces.append((int(other), 0, take, sequence, at))
                at += take
                if take < lengths[other]:
                    rest = (int(other), take)
                if at == window:
                    break
        while at < window:  # no neighbour is left: take the next unused in order
            while fresh < len(used) and used[fresh]:
                fresh += 1
            if fresh == len(used):
                return _tail(pieces, sequence, at)
            used[fresh] = True
            take = min(window - at, int(lengths[fresh]))
            pieces.append((fresh, 0, take, sequence, at))
            at += take
            if take < lengths[fresh]:
                rest = (fresh, take)
        sequence += 1
    return pieces


def _tail(pieces: list[tuple[int, int, int, int, int]], sequence: int, length: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last sequence to lengths that are powers of two."""
    last = [p for p in pieces if p[3] == sequence]
    pieces = [p for p in pieces if p[3] != sequence]
    ends, at = [], 0
    while at < length:
        at += 1 << ((length - at).bit_length() - 1)
        ends.append(at)
    begin = 0
    for end in ends:
        for doc, start, size, _, offset in last:
            s, e = max(offset, begin), min(offset + size, end)
            if s < e:
                pieces.append((doc, start + s - offset, e - s, sequence, s - begin))
        begin, sequence = end, sequence + 1
    return pieces


TOKENS = "doc_id long, ids binary, sample binary, terms array<long>, counts array<long>"


def tokens_and_counts(df: DataFrame, path: str, part: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, sample, terms, counts): a row a document, with its ids again in ``sample`` for a share ``part`` of
    them, and a last row a task: in how many of its documents each term is, the documents under -1, their tokens under -2.

    What is sampled hangs on id and place in the task, so equal rows are not all taken or all left.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    limit = int(part * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = encoder(path), TaskContext.get()
        total = np.zeros(1 << 16, np.int64)
        pair, width = (np.uint32, 16) if enc.dtype == "<u2" else (np.uint64, 32)
        task, length, seen = context.partitionId() if context else 0, 0, 0
        names = ["doc_id", "ids", "sample", "terms", "counts"]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            out, sample = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.encode(t.as_py())
                ids = np.frombuffer(raw, enc.dtype)
                length, seen = length + len(ids) + 1, seen + 1
                out.append(raw)
                sample.append(raw if zlib.crc32(f"{doc} {task} {seen}".encode()) < limit else None)
            # A term once for each document that has it, all documents of the batch in one sort.
            both = np.repeat(np.arange(len(out), dtype=pair), [len(raw) // (width // 8) for raw in out]) << pair(width) | np.frombuffer(b"".join(out), enc.dtype)
            both.sort()
            own = np.bincount((both[np.diff(both, prepend=~both[:1]) != 0] & pair((1 << width) - 1)).astype(np.int64), minlength=len(total))
            total = np.pad(total, (0, len(own) - len(total))) + own
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(sample, pa.binary()), *(pa.nulls(len(out), k) for k in kinds[3:])], names)
        terms = np.flatnonzero(total)
        figures = ([None], [None], [None], [np.r_[terms, -1, -2]], [np.r_[total[terms], seen, length]])
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(figures, kinds, strict=True)], names)

    return materialise(rows.mapInArrow(run, TOKENS), compression="snappy")


def _ranges(places: np.ndarray, lengths: np.ndarray, tasks: int) -> np.ndarray:
    """Places that cut a sample into ``tasks`` parts of about as many tokens."""
    order = np.argsort(places, kind="stable")
    held = np.cumsum(lengths[order] + 1.0)
    at = np.searchsorted(held, held[-1] * np.arange(1, tasks) / tasks) if len(held) else np.zeros(0, np.int64)
    return places[order][np.minimum(at, len(held) - 1)] if len(held) else np.zeros(0, np.int64)


def in_lexical_order(tokens: DataFrame, frequency: np.ndarray, documents: int, length: int, shard: int, dtype: str) -> DataFrame:
    """(doc_id, ids) of all documents, with near ones in the same partition and side by side."""
    spark = tokens.sparkSession
    order = LexicalOrder(frequency, documents, length / max(documents, 1))
    unfitted = spark.sparkContext.broadcast(order)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(t.as_py(), dtype) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in unfitted.value.vectors(ids)], pa.binary()), pa.array(list(map(len, ids)), pa.int64())], ["vector", "tokens"])

    found = tokens.where("sample is not null").select("sample").mapInArrow(vectors, "vector binary, tokens long").toArrow()  # about SAMPLE vectors
    rows = sorted(zip(found["vector"].to_pylist(), found["tokens"].to_pylist(), strict=True))  # whatever the partitions
    sample = np.frombuffer(b"".join(v for v, _ in rows), np.float32).reshape(-1, DIMENSIONS)
    order.fit(sample)
    tasks = max(1, min(-(-length // (TASK_SHARDS * shard)), len(sample) // TASK_SAMPLE))
    cuts = _ranges(order.places(sample), np.array([n for _, n in rows], np.int64), tasks)
    fitted = spark.sparkContext.broadcast((order, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, borders = fitted.value
        seen = 0
        for b in batches:
            at = model.places(model.vectors([np.frombuffer(t.as_py(), dtype) for t in b.column(1)]))
            low, high = np.searchsorted(borders, at, "left"), np.searchsorted(borders, at, "right")
            # Documents at a border, as the copies of one are, are dealt to all tasks that meet there.
            row = np.arange(seen, seen + len(at), dtype=np.uint64) * np.uint64(SCATTER) >> np.uint64(33)
            seen += len(at)
            task = low + (row % (high - low + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array(task.astype(np.int32))], ["doc_id", "ids", "place", "task"])

    placed = tokens.where("ids is not null").select("doc_id", "ids").mapInArrow(place, "doc_id long, ids binary, place long, task int")
    return placed.repartitionById(tasks, F.col("task")).sortWithinPartitions("place", "doc_id").select("doc_id", "ids")


def pack(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``end_id`` follows each document's ids. Defined cases: null and empty texts are
    the end id alone; null ids and repeated rows are packed like others; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    tokens = tokens_and_counts(df, path, min(1.0, SAMPLE / max(df.select(F.lit(1)).count(), 1)), id_col, text_col)
    pairs = tokens.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    counts = pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n")).collect()  # at most the vocabulary
    of = {r["term"]: r["n"] for r in counts}
    documents, length = of.pop(-1, 0), of.pop(-2, 0)
    frequency = np.zeros(max([end_id, *of]) + 1, np.int64)
    frequency[list(of)] = list(of.values())
    held, dtype = spark.sparkContext.broadcast(frequency), encoder(path).dtype
    ordered = in_lexical_order(tokens, frequency, documents, length, shard, dtype)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36

        def flush(docs: list, ids: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
            lengths = np.array([len(x) + 1 for x in ids], np.int64)
            rows = pack_shard(lengths, ShardIndex(ids, held.value, documents, length / max(documents, 1)), window)
            doc, start, size, seq, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            whole = [np.r_[x, np.array([end_id], x.dtype)].astype("<u4") for x in ids]
            sums = [zlib.crc32(whole[d][s : s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            names = pa.array(docs, pa.int64()).take(pa.array(doc))
            out = [names, *(pa.array(c, pa.int64()) for c in (start, size, sums, lengths[doc], sequence + seq, offset))]
            return pa.RecordBatch.from_arrays(out, columns), int(seq.max()) + 1

        docs, ids, held_tokens = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(d)
                ids.append(np.frombuffer(t.as_py(), dtype))
                held_tokens += len(ids[-1]) + 1
                if held_tokens >= shard:
                    out, n = flush(docs, ids)
                    yield out
                    docs, ids, held_tokens, sequence = [], [], 0, sequence + n
        if docs:
            yield flush(docs, ids)[0]

    return ordered.mapInArrow(packed, ", ".join(f"{c} long" for c in columns))
