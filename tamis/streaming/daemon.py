"""The daemon: files that arrive become partitions, partitions become canonical lists.

Each poll is a micro-batch of eligible files: the quiet period and the name
filters are applied before files enter, and a file leaves the inbox when it is
claimed, so nothing is seen twice. Work is keyed by content hash: partitions are
overwritten, moves repeat harmlessly, and the ledger says how far a source got.
"""

from __future__ import annotations

import os
import shutil
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import Config
from tamis.operators.aggregate import INDEX_SCHEMA, aggregate
from tamis.operators.artifacts import filled
from tamis.operators.dedup import max_ids
from tamis.plans import observability as obs
from tamis.plans.extraction import artifact_path, featured, indicators, retained
from tamis.plans.ports import Ports
from tamis.sources import csvio, ledger as led
from tamis.sources.inbox import Lifecycle, ready_files
from tamis.sources.tables import materialise


class AlreadyRunning(RuntimeError):
    """An aggregation is under way."""


@dataclass
class Outcome:
    """What became of one file."""

    key: str
    status: str
    duplicate: bool = False
    partitions: tuple[str, ...] = ()


@dataclass
class AggregationState:
    """Of the last aggregation, for health checks."""

    last_success: str | None = None
    last_failure: str | None = None
    reason: str | None = None
    running: bool = False


@dataclass
class Daemon:
    spark: SparkSession
    config: Config
    sleep: Callable[[float], None] = time.sleep
    state: AggregationState = field(default_factory=AggregationState)
    ports: Ports = field(default_factory=Ports)
    ledger: led.Ledger | None = None  # anything with its methods; a file by default
    life: Lifecycle | None = None

    def __post_init__(self) -> None:
        self.ledger = self.ledger or led.Ledger(self.config.ingestion.ledger)
        self.life = self.life or Lifecycle(self.config.ingestion)
        self._lock = threading.Lock()
        self._stop = threading.Event()
        self.lookup: DataFrame | None = materialise(self.ports.lookup(self.spark, self.config.lookup.artifacts, self.config.csv)) if self.config.lookup.artifacts else None
        self.tops = {r["artifact"]: r["max_id"] for r in max_ids(self.lookup).collect()} if self.lookup is not None else {}

    # -- ingestion ---------------------------------------------------------

    def poll(self) -> list[Outcome]:
        """One batch of files from the inbox, each with retries."""
        c = self.config.ingestion
        files = ready_files(c.inbox, c.include, c.exclude, c.quiet_seconds, c.max_files_per_poll)
        return [o for f in files if (o := self.ingest_with_retry(f)) is not None]

    def key_of(self, path: str) -> str:
        """Content hash, computed by Spark where the file is."""
        return self.spark.read.format("binaryFile").load(path).select(F.lower(F.sha2("content", 256)).alias("k")).first()["k"]

    def ingest_with_retry(self, path: str) -> Outcome | None:
        c, key = self.config.ingestion, self.key_of(path)
        for attempt in range(1, max(1, c.max_attempts) + 1):
            try:
                return self.ingest(path, key)
            except Exception as e:  # noqa: BLE001 - rejected after the last attempt
                if attempt >= max(1, c.max_attempts):
                    self.reject(key, str(e))
                    return Outcome(key, led.FAILED)
                self.sleep(c.backoff_seconds)
        return None

    def ingest(self, path: str, key: str) -> Outcome:
        """Idempotent by content: known sources are archived as duplicates, failed ones left alone, others carried on."""
        known = self.ledger.find(key)
        if known is not None:
            if known.status in {led.SOURCE_ARCHIVED, led.AGGREGATED}:
                self.life.archive(path, key)
                return Outcome(key, known.status, True, known.partitions)
            return Outcome(key, known.status, False, known.partitions) if known.status == led.FAILED else self.recover(known)
        unit = self.life.claim(path, key, led.now())
        try:
            record = self.ledger.mark(key, led.CLAIMED, original_path=path, processing_path=unit.path, detected_at=unit.detected_at)
        except Exception as e:
            self.life.fail(unit.path, key, str(e))
            self.ledger.mark(key, led.FAILED, reason=str(e))
            raise
        return self.process(record)

    def process(self, record: led.Record) -> Outcome:
        paths = self.write_partitions(record)
        self.ledger.mark(record.key, led.PARTITION_WRITTEN, partitions=tuple(paths))
        self.ledger.mark(record.key, led.LEDGER_RECORDED)
        return self.archive(self.ledger.find(record.key))

    def archive(self, record: led.Record) -> Outcome:
        if record.processing_path is None:
            raise RuntimeError(f"record without processing path: {record.key}")
        done = self.life.archive(record.processing_path, record.key)
        self.ledger.mark(record.key, led.SOURCE_ARCHIVED, archived_path=done)
        return Outcome(record.key, led.SOURCE_ARCHIVED, False, record.partitions)

    def write_partitions(self, record: led.Record) -> list[str]:
        """<partitions>/<artifact>/<day>/<key>.csv, ids from a start of their own for each source."""
        documents = materialise(self.ports.read(self.spark, record.processing_path, self.config.charset))
        wrong = documents.where("error is not null").select("error").first()
        if wrong is not None:
            raise RuntimeError(wrong["error"])
        kept = materialise(featured(retained(indicators(documents, self.config, "doc_id"), self.config, self.lookup, "doc_id"), self.config))
        day = datetime.fromisoformat(record.detected_at).astimezone(timezone.utc).strftime("%Y-%m-%d")
        paths = []
        for artifact in self.config.enabled():
            path = os.path.join(self.config.ingestion.partitions, artifact.name, day, f"{record.key}.csv")
            self.ports.write(filled(kept, artifact, self.tops), path, [c.name for c in artifact.columns], dialect=self.config.csv)
            paths.append(path)
        return paths

    def recover(self, record: led.Record) -> Outcome:
        if record.status == led.CLAIMED:
            return self.process(record)
        if record.status == led.PARTITION_WRITTEN:
            record = self.ledger.mark(record.key, led.LEDGER_RECORDED)
        if record.status == led.LEDGER_RECORDED:
            return self.archive(record)
        return Outcome(record.key, record.status, False, record.partitions)

    def recover_incomplete(self) -> list[Outcome]:
        """Before the first poll: carry on what was interrupted, fail files that have no record."""
        out = [self.recover(r) for r in self.ledger.incomplete()]
        for unit in self.life.processing():
            if self.ledger.find(unit.key) is None:
                reason = "left in processing, and the ledger does not know it"
                self.life.fail(unit.path, unit.key, reason)
                self.ledger.mark(unit.key, led.FAILED, reason=reason)
                out.append(Outcome(unit.key, led.FAILED))
        return out

    def reject(self, key: str, reason: str) -> None:
        """To the failed folder with its reason; a record is made up if there is none."""
        record = self.ledger.find(key)
        if record is not None and record.processing_path is not None:
            self.life.fail(record.processing_path, key, reason)
        self.ledger.mark(key, led.FAILED, reason=reason)

    # -- aggregation -------------------------------------------------------

    def aggregate(self, only: tuple[str, ...] = ()) -> list[dict] | None:
        """Merge all ready sources; ids are saved first, lists next, sources are marked last. None if nothing is ready."""
        if not self._lock.acquire(blocking=False):
            raise AlreadyRunning
        self.state.running = True
        try:
            with obs.scope(ioc__mode="daemon"):
                obs.event("aggregation_start")
                counters = self._aggregate(only)
                obs.event("aggregation_complete", "success", ioc__rows=sum(c["rows_written"] for c in counters or []))
            self.state.last_success = led.now()
            return counters
        except Exception as e:
            self.state.last_failure, self.state.reason = led.now(), str(e)
            obs.event("aggregation_complete", "failure", str(e))
            raise
        finally:
            self.state.running = False
            self._lock.release()

    def _aggregate(self, only: tuple[str, ...]) -> list[dict] | None:
        records = self.ledger.ready()
        if not records:
            return None
        c = self.config.aggregation
        enabled = {a.name: a for a in self.config.enabled()}
        merges = [m for name in enabled for m in c.merges if m.name == name and (not only or name in only)]
        sources = led.table(self.spark, records).select(F.explode("partitions").alias("path"), F.col("key").alias("source_key"), "detected_at")
        canonical, arrived = {}, {}
        for m in merges:
            columns = [x.name for x in enabled[m.name].columns]
            canonical[m.name] = materialise(self._ordered(csvio.read(self.spark, artifact_path(self.config, enabled[m.name]), columns, self.config.csv), "__row"))
            paths = [p for r in records for p in r.partitions if self.artifact_of(p, enabled) == m.name and os.path.exists(p)]
            arrived[m.name] = materialise(self._arrived(paths, columns, sources))
        index = self._index(c.id_index)
        result = aggregate(canonical, arrived, index, merges, global_ids=c.global_ids)
        counters = [r.asDict() for r in result.counters.collect()] if merges else []
        rows = result.index.orderBy("id")
        self._save_index(rows, c.id_index)
        for m in merges:
            self.ports.write(result.artifacts[m.name], artifact_path(self.config, enabled[m.name]), [x.name for x in enabled[m.name].columns], dialect=self.config.csv)
        for r in records:
            self.ledger.mark(r.key, led.AGGREGATED)
        return counters

    @staticmethod
    def artifact_of(path: str, names: dict) -> str | None:
        """The first part of a path that is the name of an artifact."""
        return next((p for p in path.replace("\\", "/").split("/") if p in names), None)

    def _ordered(self, rows: DataFrame, out: str) -> DataFrame:
        """Rows of one file in its order: a file with quoted line feeds is read by one task, so ids grow with place."""
        return rows.withColumn(out, F.monotonically_increasing_id())

    def _arrived(self, paths: list[str], columns: list[str], sources: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "detected_at timestamp, source_key string, ordinal long"]))
        if not paths:
            return empty
        options = {"sep": self.config.csv.delimiter, "header": True, "nullValue": self.config.csv.null_literal, "quote": self.config.csv.quote, "escape": self.config.csv.quote, "emptyValue": "", "multiLine": True}
        rows = self.spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in columns)).csv(paths)
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
        own = rows.withColumn("source_key", name).withColumn("ordinal", F.monotonically_increasing_id())
        return own.join(sources.select("source_key", "detected_at").distinct(), "source_key").select(*columns, "detected_at", "source_key", "ordinal")

    def _index(self, path: str) -> DataFrame:
        rows = csvio.read(self.spark, path, ["artifact", "key", "id", "created_at", "updated_at"], self.config.csv)
        return materialise(rows.select("artifact", "key", F.col("id").cast("long").alias("id"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("updated_at").cast("timestamp").alias("updated_at")))

    def _save_index(self, rows: DataFrame, path: str) -> None:
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
        text = rows.select("artifact", "key", F.col("id").cast("string").alias("id"), stamp("created_at"), stamp("updated_at"), F.col("id").alias("__row"))
        csvio.write_file(materialise(text), path, ["artifact", "key", "id", "created_at", "updated_at"], dialect=self.config.csv)

    # -- life --------------------------------------------------------------

    def health(self) -> dict[str, object]:
        """Up if ledger and artifact folders can be written and the last aggregation did not fail."""

        def writable(folder: str) -> bool:
            os.makedirs(folder, exist_ok=True)
            return os.access(folder, os.W_OK) and shutil.disk_usage(folder).free > 0

        ledger_ok = writable(self.config.ingestion.ledger)
        lists_ok = all(writable(os.path.dirname(os.path.abspath(artifact_path(self.config, a)))) for a in self.config.enabled())
        s = self.state
        aggregation_ok = s.last_failure is None or (s.last_success is not None and s.last_success >= s.last_failure)
        return {"up": ledger_ok and lists_ok and aggregation_ok, "ledger": ledger_ok, "artifacts": lists_ok, "aggregation": aggregation_ok, "running": s.running, "reason": s.reason}

    def run(self, polls: int | None = None) -> None:
        """Recover, then poll, and aggregate on a thread of its own, until ``stop`` (or so many polls)."""
        obs.event("app_start")
        self.recover_incomplete()
        timer = threading.Thread(target=self._schedule, daemon=True)
        if self.config.aggregation.enabled:
            timer.start()
        done = 0
        while not self._stop.is_set() and (polls is None or done < polls):
            self.poll()
            done += 1
            if polls is None or done < polls:
                self._stop.wait(self.config.ingestion.poll_seconds)
        self._stop.set()
        if timer.is_alive():
            timer.join()
        obs.event("app_stop", "success")

    def _schedule(self) -> None:
        wait = self.config.aggregation.initial_delay_seconds
        while not self._stop.wait(wait):
            try:
                self.aggregate()
            except Exception:  # noqa: BLE001, S110 - noted in the state; the next run repeats
                pass
            wait = self.config.aggregation.interval_seconds

    def stop(self) -> None:
        self._stop.set()
