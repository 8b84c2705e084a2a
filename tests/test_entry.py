"""Queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tamis.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUICK = ["refang_feed", "matches_domain", "indicator_spans", "asof_labels", "mask_matches", "dedup_lookup_anti", "artifact_masks", "artifact_hashes", "stable_ids", "aggregation_counters", "ledger_ready", "diagnostic_messages"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    frame = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert sorted(sql.columns) == columns
    order = [sql.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=key)


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_library_does_not_need_the_corpus_operators():
    root = Path(entry.__file__).parent
    for f in [*root.glob("tamis/**/*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"tamis\.llm|corpus_pipeline", f.read_text(encoding="utf-8")), f
