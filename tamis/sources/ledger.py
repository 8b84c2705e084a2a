"""The ingestion ledger: one small file a source, replaced atomically, and its views as DataFrames."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMED, PARTITION_WRITTEN, LEDGER_RECORDED, SOURCE_ARCHIVED, AGGREGATED, FAILED = STATES = ("CLAIMED", "PARTITION_WRITTEN", "LEDGER_RECORDED", "SOURCE_ARCHIVED", "AGGREGATED", "FAILED")
SCHEMA = "key string, status string, original_path string, processing_path string, archived_path string, partitions array<string>, detected_at timestamp, updated_at timestamp, reason string"


@dataclass(frozen=True)
class Record:
    key: str
    status: str
    original_path: str | None = None
    processing_path: str | None = None
    archived_path: str | None = None
    partitions: tuple[str, ...] = field(default_factory=tuple)
    detected_at: str | None = None
    updated_at: str | None = None
    reason: str | None = None


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Ledger:
    """Records by source key in a folder; written on the driver only."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, f"{key.lower()}.json")

    def find(self, key: str) -> Record | None:
        try:
            with open(self._path(key), encoding="utf-8") as f:
                data = json.load(f)
        except FileNotFoundError:
            return None
        return Record(**{**data, "partitions": tuple(data["partitions"])})

    def save(self, record: Record) -> Record:
        os.makedirs(self.folder, exist_ok=True)
        record = replace(record, updated_at=now())
        handle, temporary = tempfile.mkstemp(dir=self.folder, suffix=".tmp")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(asdict(record), f)
        os.replace(temporary, self._path(record.key))
        return record

    def mark(self, key: str, status: str, **changes: object) -> Record:
        """The record of ``key`` with another status; a failed one is made up if there is none."""
        if status not in STATES:
            raise ValueError(f"unknown status: {status}")
        record = self.find(key) or Record(key.lower(), status)
        return self.save(replace(record, status=status, **changes))

    def records(self) -> list[Record]:
        if not os.path.isdir(self.folder):
            return []
        keys = sorted(n[: -len(".json")] for n in os.listdir(self.folder) if n.endswith(".json"))
        return [r for r in map(self.find, keys) if r is not None]

    def incomplete(self) -> list[Record]:
        return [r for r in self.records() if r.status not in {SOURCE_ARCHIVED, AGGREGATED, FAILED}]

    def ready(self) -> list[Record]:
        """Archived sources with partitions, by time of detection (unknown last), then key."""
        found = [r for r in self.records() if r.status == SOURCE_ARCHIVED and r.partitions]
        return sorted(found, key=lambda r: (r.detected_at is None, r.detected_at or "", r.key))


def table(spark: SparkSession, records: Iterable[Record]) -> DataFrame:
    def when(value: str | None) -> datetime | None:
        return datetime.fromisoformat(value) if value else None

    rows = [(r.key, r.status, r.original_path, r.processing_path, r.archived_path, list(r.partitions), when(r.detected_at), when(r.updated_at), r.reason) for r in records]
    return spark.createDataFrame(rows, SCHEMA)


def incomplete(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("status").isin(SOURCE_ARCHIVED, AGGREGATED, FAILED))


def ready(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("status") == SOURCE_ARCHIVED) & (F.size("partitions") > 0)).orderBy(F.col("detected_at").asc_nulls_last(), "key")


def orphans(processing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files in processing (key, path) without a record."""
    return processing.join(ledger.select("key"), "key", "left_anti")


def current(events: DataFrame) -> DataFrame:
    """Latest record of each key of a table of status events with a growing ``seq``."""
    fields = [c for c in events.columns if c not in ("key", "seq")]
    return events.groupBy("key").agg(F.max_by(F.struct(*fields), "seq").alias("r")).select("key", "r.*")
