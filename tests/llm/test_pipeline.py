"""The pipeline, stage by stage, against plain Python; and the registered queries."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamis.llm.common import materialise
from tests.llm.test_operators import copies, corpus, slow_components, slow_fingerprint, slow_spans


def test_stages(spark, tmp_path):
    docs, labels, truth = corpus(spark)
    docs = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    extra = docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" password = hunter2hunter2")))
    twins = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 6000)
    docs.unionByName(extra).unionByName(twins).dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, now, str(tmp_path)))
        if name != "packing":
            assert after.columns == now.columns
        rows = {r["doc_id"]: r["text"] for r in now.collect()}
        ids = {r["doc_id"] for r in after.collect()}
        if name == "quality":
            good = {i for i, q, _ in truth if q}
            assert len(good - ids) < 0.05 * len(good)
        elif name == "exact_dedup":
            assert ids == {i for i, _ in copies(rows.items()).values()}
        elif name == "near_dedup":
            fps = {i: slow_fingerprint(t) for i, t in rows.items()}
            assert ids == set(slow_components(fps).values())
        elif name == "secrets":
            assert ids == set(rows)
            for r in after.collect():
                assert not [s for s in slow_spans(r["text"] or "") if s[2] == "assign"] and ("hunter2" not in (r["text"] or ""))
        else:
            assert ids == set(rows)
        before[name] = len(rows)
        now = after
    assert before["exact_dedup"] > before["near_dedup"] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_queries_are_registered():
    names = list(entry.queries())
    assert all(sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert "op1_exact_dedup" in entry.oracle_sql()


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs, labels, _ = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))  # docs has null ids, null texts, repeated rows and clashing columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {None, 8} & {p["doc_id"] for p in pieces} and len({p["doc_id"] for p in pieces}) > 400
    docs.where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    labels.where("false").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
