"""Source attribution: the nearest marker at or before each indicator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.config import MARKERS, UNKNOWN_LABEL
from tamis.functions.arrays import count_before
from tamis.functions.text import marker_label
from tamis.operators.extract import find_all


def markers(text: Column, patterns: Iterable[str] = MARKERS, engine: str = "re2j") -> Column:
    """Array of (start, rank, label), ordered by start, then by the order of the patterns."""
    found = []
    for rank, pattern in enumerate(patterns):
        found.append(_ranked(find_all(text, pattern, engine), rank))
    return F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<start:int,rank:int,label:string>>")


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), marker_label(s["value"]).alias("label")))


def attributed(df: DataFrame) -> DataFrame:
    """Adds source_label to each element of ``indicators``; UNKNOWN before the first marker.

    Of markers at one place the later pattern wins.
    """

    fields = ("start", "end", "type", "value")

    def labelled(markers: Column) -> Column:
        def label(i: Column) -> Column:
            return F.coalesce(F.get(markers, count_before(markers, i["start"] + 1) - 1)["label"], F.lit(UNKNOWN_LABEL))

        return F.transform("indicators", lambda i: F.struct(*[i[f].alias(f) for f in fields], label(i).alias("source_label")))

    # The markers become a lambda variable, so they are found once a row and not once an indicator.
    return df.withColumn("indicators", F.get(F.transform(F.array("markers"), labelled), F.lit(0)))


def asof_labels(indicators: DataFrame, marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The relational form for tables: ``indicators(key, start, ...)``, ``marks(key, start, rank, label)``.

    A union in place order and a running last label; one shuffle by ``key``.
    """
    cols = [c for c in indicators.columns if c not in (key, "start")]
    left = indicators.select(key, "start", F.lit(1).alias("__late"), F.lit(0).alias("__rank"), F.lit(None).cast("string").alias("__label"), *cols)
    right = marks.select(key, "start", F.lit(0).alias("__late"), F.col("rank").alias("__rank"), F.col("label").alias("__label"), *[F.lit(None).cast(indicators.schema[c].dataType).alias(c) for c in cols])
    ordered = Window.partitionBy(key).orderBy("start", "__late", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("source_label", F.coalesce(F.last("__label", ignorenulls=True).over(ordered), F.lit(UNKNOWN_LABEL)))
    return out.where("__late = 1").select(*indicators.columns, "source_label")
