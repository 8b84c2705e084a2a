"""What a run reads from and writes to, as protocols that a caller can replace."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tamis.config import Csv
from tamis.sources import csvio, documents, lookup


class SourceReader(Protocol):
    def __call__(self, spark: SparkSession, path: str | list[str], charset: str) -> DataFrame:
        """(doc_id, path, source_key, modified, text, error): one row a source; a null text has its reason in ``error``."""


class LookupReader(Protocol):
    def __call__(self, spark: SparkSession, lists: dict[str, str], dialect: Csv) -> DataFrame:
        """(artifact, kind, key, id) of existing lists."""


class Sink(Protocol):
    def __call__(self, rows: DataFrame, path: str, columns: list[str], *, dialect: Csv) -> int:
        """Write ``rows`` (strings, and __row, their order) as one list; how many there were."""


@dataclass(frozen=True)
class Ports:
    """The ports of a run; those of files are the default."""

    read: SourceReader = field(default=documents.read_documents)
    lookup: LookupReader = field(default=lookup.entries)
    write: Sink = field(default=csvio.write_list)
