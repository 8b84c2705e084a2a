"""Encoding and decoding of whole texts as a Spark operator."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.bpe import encoder
from tamis.llm.common import bounded_batches, text_of


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Defined cases: null text counts as empty and has no ids; repeated rows give a row
    each; null ids pass; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size = max(enc.bytes_of) + 1
        shown = [str(i) for i in range(size)]
        spelt = [enc.bytes_of.get(i, b"") for i in range(size)]
        for b in batches:
            counts, sums, decoded = [], [], []
            for t in b.column(1):
                ids = np.frombuffer(enc.encode(t.as_py()), enc.dtype).tolist()
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                text = b"".join(map(spelt.__getitem__, ids)).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], columns)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
