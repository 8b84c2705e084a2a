"""Diagnostics: catalogue, notifications, failure policies, rendering, sinks."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Code, category, severity, message key, template.
CATALOG = (
    ("CONFIG.INVALID_PROPERTY", "CONFIG", "FATAL", "config.invalid-property", "Invalid configuration property {property}: {reason}"),
    ("CONFIG.UNKNOWN_POLICY", "CONFIG", "FATAL", "config.unknown-policy", "Unknown policy {policy}: {reason}"),
    ("SOURCE.READ_FAILED", "SOURCE", "FATAL", "source.read-failed", "Source {source} could not be read: {reason}"),
    ("SOURCE.UNSUPPORTED_FORMAT", "SOURCE", "ERROR", "source.unsupported-format", "Source {source} has unsupported format {format}"),
    ("SOURCE.EMPTY_TEXT", "SOURCE", "WARN", "source.empty-text", "Source {source} produced empty text"),
    ("EXTRACTION.PATTERN_INVALID", "EXTRACTION", "FATAL", "extraction.pattern-invalid", "Extraction pattern {pattern} is invalid: {reason}"),
    ("EXTRACTION.INDICATOR_SKIPPED", "EXTRACTION", "DEBUG", "extraction.indicator-skipped", "Indicator {indicator} was skipped: {reason}"),
    ("EXTRACTION.AMBIGUOUS_VALUE", "EXTRACTION", "WARN", "extraction.ambiguous-value", "Value {value} is ambiguous: {reason}"),
    ("CLASSIFY.AMBIGUOUS_MATCH", "CLASSIFY", "WARN", "classify.ambiguous-match", "Indicator {indicator} matched multiple classification rules: {candidates}"),
    ("CLASSIFY.UNSUPPORTED_INDICATOR_TYPE", "CLASSIFY", "ERROR", "classify.unsupported-indicator-type", "Indicator type {type} is not supported by classifier {classifier}"),
    ("SINK.WRITE_FAILED", "SINK", "FATAL", "sink.write-failed", "Sink {sink} failed to write artifact {artifact}: {reason}"),
    ("SINK.ROW_MAPPING_FAILED", "SINK", "ERROR", "sink.row-mapping-failed", "Sink {sink} failed to map row for indicator {indicator}: {reason}"),
    ("INGEST.CLAIM_FAILED", "INGEST", "FATAL", "ingest.claim-failed", "Source {source} could not be claimed for ingestion: {reason}"),
    ("INGEST.LEDGER_WRITE_FAILED", "INGEST", "FATAL", "ingest.ledger-write-failed", "Ingestion ledger update failed for source {source}: {reason}"),
    ("INGEST.RECOVERY_FAILED", "INGEST", "ERROR", "ingest.recovery-failed", "Ingestion recovery failed for source {source}: {reason}"),
    ("PIPELINE.STAGE_FAILED", "PIPELINE", "ERROR", "pipeline.stage-failed", "Pipeline stage {stage} failed: {reason}"),
    ("PIPELINE.ITEM_SKIPPED", "PIPELINE", "WARN", "pipeline.item-skipped", "Pipeline item {item} was skipped at stage {stage}: {reason}"),
)
SCHEMA = "code string, severity string, category string, context map<string,string>, ts timestamp"


@dataclass(frozen=True)
class Diagnostic:
    """Equal if code and context are."""

    code: str
    context: Mapping[str, str] = field(default_factory=dict)
    severity: str = field(default="", compare=False)
    category: str = field(default="", compare=False)
    cause: BaseException | None = field(default=None, compare=False)
    timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc), compare=False)

    def __hash__(self) -> int:
        return hash((self.code, tuple(sorted(self.context.items()))))


def diagnostic(code: str, cause: BaseException | None = None, **context: str) -> Diagnostic:
    """A diagnostic of the catalogue; an unknown code raises."""
    row = next((r for r in CATALOG if r[0] == code), None)
    if row is None:
        raise KeyError(code)
    return Diagnostic(code, context, row[2], row[1], cause)


def render(d: Diagnostic) -> str:
    """The template with its keys filled once; keys that are missing stay visible."""
    template = next((r[4] for r in CATALOG if r[0] == d.code), d.code)
    return re.sub(r"\{([^{}]+)\}", lambda m: str(d.context.get(m[1], m[0])), template)


def rendered(diagnostics: DataFrame) -> DataFrame:
    """Adds ``message`` to a table of diagnostics."""
    spark = diagnostics.sparkSession
    templates = spark.createDataFrame([(r[0], r[4]) for r in CATALOG], "code string, __template string")
    joined = diagnostics.join(F.broadcast(templates), "code", "left")  # the catalogue
    parts = F.split(F.coalesce("__template", "code"), r"(?=\{)|(?<=\})", -1)
    value = F.transform(parts, lambda p: F.when(p.rlike(r"^\{[^{}]+\}$"), F.coalesce(F.try_element_at("context", F.substring(p, F.lit(2), F.char_length(p) - 2)), p)).otherwise(p))
    return joined.withColumn("message", F.array_join(value, "")).drop("__template")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "code string, category string, severity string, message_key string, template string")


@dataclass(frozen=True)
class Notification:
    """Diagnostics gathered so far."""

    diagnostics: tuple[Diagnostic, ...] = ()

    def plus(self, *more: Diagnostic) -> Notification:
        return Notification((*self.diagnostics, *more))

    def _worst(self, least: str) -> bool:
        return any(SEVERITIES.index(d.severity) >= SEVERITIES.index(least) for d in self.diagnostics)

    @property
    def has_errors(self) -> bool:
        return self._worst("ERROR")

    @property
    def has_fatal(self) -> bool:
        return self._worst("FATAL")


def severity_checks(diagnostics: DataFrame) -> DataFrame:
    """(has_errors, has_fatal) of a table of diagnostics."""
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity").isin("ERROR", "FATAL")), F.lit(False)).alias("has_errors"), F.coalesce(F.bool_or(F.col("severity") == "FATAL"), F.lit(False)).alias("has_fatal"))


@dataclass(frozen=True)
class Result:
    """A value with its diagnostics."""

    value: Any
    notification: Notification = Notification()

    def map(self, fn: Callable[[Any], Any]) -> Result:
        return Result(fn(self.value), self.notification)


Policy = Callable[[Notification], "Diagnostic | None"]


def fail_fast(notification: Notification) -> Diagnostic | None:
    """The first diagnostic of ERROR or worse, which stops the run."""
    return next((d for d in notification.diagnostics if d.severity in {"ERROR", "FATAL"}), None)


def collect_and_continue(notification: Notification) -> Diagnostic | None:
    """Only FATAL stops the run."""
    return next((d for d in notification.diagnostics if d.severity == "FATAL"), None)


class Stopped(RuntimeError):
    """A policy ended the run."""

    def __init__(self, cause: Diagnostic) -> None:
        super().__init__(render(cause))
        self.diagnostic = cause


def table(spark: SparkSession, diagnostics: Iterable[Diagnostic]) -> DataFrame:
    return spark.createDataFrame([(d.code, d.severity, d.category, dict(d.context), d.timestamp) for d in diagnostics], SCHEMA)


class CollectingSink(list):
    """Keeps what it is given."""

    def __call__(self, d: Diagnostic) -> None:
        self.append(d)


def noop_sink(d: Diagnostic) -> None:
    """Drops what it is given."""


def logging_sink(d: Diagnostic) -> None:
    level = {"FATAL": logging.CRITICAL, "ERROR": logging.ERROR, "WARN": logging.WARNING, "INFO": logging.INFO}.get(d.severity, logging.DEBUG)
    logging.getLogger("tamis").log(level, render(d), extra={"fields": {"event.action": "diagnostic_emit", "ioc.diagnostic.code": d.code, "ioc.diagnostic.category": d.category, "ioc.diagnostic.severity": d.severity}})
