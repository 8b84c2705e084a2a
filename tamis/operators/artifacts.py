"""Artifacts: routing, filters, the column language and ids."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import Artifact, ColumnSpec
from tamis.operators.registry import ARTIFACT_PREDICATES, PROVIDERS, TRANSFORMS
from tamis.operators.sequence import numbered


def routed(df: DataFrame, artifact: Artifact) -> DataFrame:
    """Rows the artifact accepts: its types, all of ``include``, none of ``exclude``."""
    accepts = F.col("type").isin(*artifact.accepts) if artifact.accepts else F.lit(False)
    includes = reduce(lambda a, b: a & b, (ARTIFACT_PREDICATES[p]() for p in artifact.include), F.lit(True))
    excludes = reduce(lambda a, b: a | b, (ARTIFACT_PREDICATES[p]() for p in artifact.exclude), F.lit(False))
    return df.where(accepts & includes & ~excludes)


def column(spec: ColumnSpec) -> Column:
    """Provider, then type gate, then transforms; always a nullable string."""
    value = PROVIDERS[spec.source](spec.value)
    if spec.when_type is not None:
        value = F.when(F.col("type") == spec.when_type, value)
    for transform in spec.transform:
        name, _, argument = transform.partition(":")
        value = TRANSFORMS[name](value, argument)
    return value.cast("string").alias(spec.name)


def id_start(artifact: Artifact, max_ids: Mapping[str, int]) -> int:
    """The configured start, or one more than the lookup's largest id."""
    start = artifact.id.start if artifact.id else None
    try:
        return int(str(start))
    except ValueError:
        return max_ids.get(artifact.name, 0) + 1


def filled(df: DataFrame, artifact: Artifact, max_ids: Mapping[str, int] | None = None, order: tuple[str, ...] = ("doc_id", "ordinal"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the artifact, all strings, with ``keep`` and a last column ``__row`` that gives their order.

    df: retained, classified indicators; ``order`` tells them apart.
    """
    rows = numbered(routed(df, artifact), list(order), "__row")
    if artifact.id is not None:
        step = 1 if artifact.id.strategy == "ascending" else -1
        rows = rows.withColumn("__id", F.lit(id_start(artifact, max_ids or {})) + step * F.col("__row"))
    else:
        rows = rows.withColumn("__id", F.lit(None).cast("long"))
    return rows.select(*keep, *[column(c) for c in artifact.columns], "__row")
