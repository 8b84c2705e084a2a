"""The extraction plan: documents to retained indicators to artifacts."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import Artifact, Config
from tamis.operators.artifacts import filled
from tamis.operators.attribute import attributed
from tamis.operators.classify import classified, with_features
from tamis.operators.dedup import first_in_source, max_ids, not_listed
from tamis.operators.extract import exploded, extract
from tamis.plans import diagnostics as dia
from tamis.plans import observability as obs
from tamis.plans.kernel import Envelope, Pipeline, envelope, run
from tamis.plans.ports import Ports
from tamis.sources.tables import materialise

READ, REFANG, EXTRACT, ATTRIBUTE, DEDUPLICATE, WRITE = "read-source", "refang", "extract-indicators", "attribute-source", "deduplicate", "write-artifacts"


def indicators(documents: DataFrame, config: Config, *keep: str) -> DataFrame:
    """Rows (keep..., ordinal, start, end, type, value, source_label) of all indicators of ``documents(keep..., text)``."""
    found = attributed(extract(documents.select(*keep, "text"), config))
    return exploded(found, *keep)


def retained(rows: DataFrame, config: Config, lookup: DataFrame | None, *source: str) -> DataFrame:
    """First occurrences that no existing list has; both steps are off together."""
    if not config.lookup.deduplicate:
        return rows
    first = first_in_source(rows, *source)
    return first if lookup is None else not_listed(first, lookup)


def featured(rows: DataFrame, config: Config) -> DataFrame:
    return classified(with_features(rows), config.rules)


@dataclass(frozen=True)
class Summary:
    """Counts of a run; no artifact is listed in a dry run."""

    extracted: int
    retained: int
    written: Mapping[str, int]

    def __str__(self) -> str:
        return "\n".join([f"Extracted={self.extracted}, retained={self.retained}", *(f"{k}={v}" for k, v in self.written.items())])


def artifact_path(config: Config, artifact: Artifact) -> str:
    return artifact.path if os.path.isabs(artifact.path) else os.path.join(config.output_dir, artifact.path)


def extraction_pipeline(spark: SparkSession, config: Config, *, dry_run: bool = False, ports: Ports = Ports()) -> Pipeline:  # noqa: B008 - frozen
    """Read, refang and extract (one plan), attribute, de-duplicate, write."""

    def read(e: Envelope) -> Envelope:
        found = materialise(ports.read(spark, e.payload, config.charset))
        obs.event("source_read", "success", ioc__source__path=str(e.payload))
        wrong = [dia.diagnostic("SOURCE.UNSUPPORTED_FORMAT" if r["error"].startswith("UnsupportedFormat") else "SOURCE.READ_FAILED", source=r["path"], reason=r["error"], format=r["path"].rpartition(".")[2]) for r in found.where("error is not null").select("path", "error").orderBy("path").toLocalIterator()]
        empty = [dia.diagnostic("SOURCE.EMPTY_TEXT", source=r["path"]) for r in found.where("trim(text) = ''").select("path").orderBy("path").toLocalIterator()]
        return e.with_payload(found.where("error is null"), *wrong, *empty)

    def find(e: Envelope) -> Envelope:
        return e.with_payload(extract(e.payload.select("doc_id", "text"), config))

    def attribute(e: Envelope) -> Envelope:
        return e.with_payload(materialise(exploded(attributed(e.payload), "doc_id")))

    def deduplicate(e: Envelope) -> Envelope:
        lookup = ports.lookup(spark, config.lookup.artifacts, config.csv) if config.lookup.artifacts else None
        if lookup is not None:
            lookup = materialise(lookup)
            obs.event("lookup_load", "success", ioc__rows=lookup.count())
        tops = {r["artifact"]: r["max_id"] for r in max_ids(lookup).collect()} if lookup is not None else {}
        kept = materialise(featured(retained(e.payload, config, lookup, "doc_id"), config))
        return e.with_payload((e.payload.count(), kept.count(), kept, tops))

    def write(e: Envelope) -> Envelope:
        extracted, count, kept, tops = e.payload
        written: dict[str, int] = {}
        if not dry_run:
            for artifact in config.enabled():
                rows = filled(kept, artifact, tops)
                path = artifact_path(config, artifact)
                written[artifact.name] = ports.write(rows, path, [c.name for c in artifact.columns], dialect=config.csv)
                obs.event("artifact_write", "success", ioc__artifact__name=artifact.name, ioc__rows=written[artifact.name], file__path=path)
        return e.with_payload(Summary(extracted, count, written))

    return Pipeline().then(READ, read).then(EXTRACT, find).then(ATTRIBUTE, attribute).then(DEDUPLICATE, deduplicate).then(WRITE, write)


def extract_source(spark: SparkSession, source: str, config: Config | None = None, *, dry_run: bool = False, policy: dia.Policy = dia.fail_fast, ports: Ports = Ports()) -> Summary:  # noqa: B008 - frozen
    """The one-shot run: a file or folder to the lists of the configuration."""
    config = config or Config()
    with obs.scope(ioc__mode="oneshot"):
        obs.event("command_start")
        summary = run(extraction_pipeline(spark, config, dry_run=dry_run, ports=ports), envelope(source, os.path.abspath(source)), policy).payload
        obs.event("command_complete", "success", ioc__rows=sum(summary.written.values()))
    return summary
