"""De-duplication within a source and against existing lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text

#: Entries of a lookup (short keys) up to which it is broadcast, after they are counted.
BROADCAST_ROWS = 2_000_000


def first_in_source(df: DataFrame, *source: str) -> DataFrame:
    """The first row of each type and value in every source, by ordinal; case matters."""
    place = Window.partitionBy(*source, "type", "value").orderBy("ordinal")
    return df.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def first_by(*order: str) -> Callable[[DataFrame], DataFrame]:
    """Of the rows of each __key the first in ``order`` (nulls last); rows without a key are left out."""

    def first(rows: DataFrame) -> DataFrame:
        place = Window.partitionBy("__key").orderBy(*[F.col(c).asc_nulls_last() for c in order])
        return rows.where("__key is not null").withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")

    return first


def lookup_kind(kind: Column, value: Column) -> Column:
    """Which existing list an indicator is looked up in: ip, mask or the hash's own."""
    return (
        F.when((kind == "IPV4") & text.is_bare_address(value), "ip")
        .when(kind.isin("IPV4", "DOMAIN", "URL"), "mask")
        .otherwise(F.concat(F.lit("hash_"), F.lower(kind)))
    )


def lookup_key(kind: Column, value: Column) -> Column:
    """Addresses in lower case, hashes in upper case."""
    return F.when(kind.isin("IPV4", "DOMAIN", "URL"), F.lower(value)).otherwise(F.upper(value))


def not_listed(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows with no entry in ``lookup(kind, key)``. A small lookup is broadcast after a count, a large one joined."""
    listed = lookup.select(F.col("kind").alias("__kind"), F.col("key").alias("__key")).where("__key is not null").distinct()
    keyed = df.withColumn("__kind", lookup_kind(F.col("type"), F.col("value"))).withColumn("__key", lookup_key(F.col("type"), F.col("value")))
    small = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(listed) if small else listed, ["__kind", "__key"], "left_anti").select(*df.columns)


def max_ids(lookup: DataFrame) -> DataFrame:
    """(artifact, max_id): the largest id of each list; what doesn't parse is 0."""
    return lookup.groupBy("artifact").agg(F.max(text.parse_id(F.col("id").cast("string"))).alias("max_id"))
