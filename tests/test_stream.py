"""Streaming ingestion: nothing is lost, nothing is counted twice."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tamis.config import Config
from tamis.streaming.files import FAILED, KEYS, ingest_stream, settled


def config(**more):
    base = Config()
    return replace(base, ingestion=replace(base.ingestion, **{"include": ("*.txt",), "exclude": ("skip*",), "quiet_seconds": 0, "backoff_seconds": 0, "max_attempts": 2, **more}))


def run(spark, tmp_path):
    sleeps = []
    ingest_stream(spark, str(tmp_path / "inbox"), str(tmp_path / "table"), str(tmp_path / "checkpoint"), config(), sleep=sleeps.append).trigger(availableNow=True).start().awaitTermination()
    return sleeps


def test_sources_are_read_once_and_failures_are_kept(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("evil.com 1.2.3.4")
    (inbox / "b.txt").write_text("evil.com 1.2.3.4")  # a copy in the same batch
    (inbox / "bad.txt").write_bytes(b"%PDF-1.4")
    (inbox / "empty.txt").write_text(" ")
    (inbox / "skip.txt").write_text("skipped.com")
    run(spark, tmp_path)
    (inbox / "c.txt").write_text("evil.com 1.2.3.4")  # a copy in a later batch
    (inbox / "d.txt").write_text("other.com")
    run(spark, tmp_path)
    rows = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r["value"] for r in rows.collect()) == ["1.2.3.4", "evil.com", "other.com"]
    failed = spark.read.parquet(str(tmp_path / "table") + FAILED).collect()
    assert [r["path"].rpartition("/")[2] for r in failed] == ["bad.txt"] and "PDF" in failed[0]["error"]
    keys = spark.read.parquet(str(tmp_path / "table") + KEYS)
    assert {(r["path"].rpartition("/")[2], r["status"]) for r in keys.collect()} == {("a.txt", "READ"), ("b.txt", "READ"), ("bad.txt", "FAILED"), ("empty.txt", "READ"), ("c.txt", "READ"), ("d.txt", "READ")}


def test_files_that_change_are_waited_for(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    changed = (tmp_path / "a.txt").stat().st_mtime
    clock, slept = [changed + 4], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    assert [p.rpartition("/")[2] for p in settled(files, 10, sleep, lambda: clock[0])] == ["a.txt"]
    assert len(slept) == 1 and abs(slept[0] - 6) < 0.01
    (tmp_path / "a.txt").unlink()
    gone = spark.createDataFrame([(str(tmp_path / "a.txt"), changed)], "path string, at double").select("path", F.timestamp_seconds("at").alias("modificationTime"))
    assert settled(gone, 10, sleep, lambda: changed) == []
