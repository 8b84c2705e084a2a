"""Kinds of hosts by the public suffix list.

The list is the one in the library that ships with Spark; a table of (suffix,
kind) can be given instead. It is grouped by top-level domain and broadcast (a
few thousand short rows, whatever the input), so classifying needs no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IP, REGISTRABLE, SUBDOMAIN, ONION, UNKNOWN = "IP", "REGISTRABLE", "SUBDOMAIN", "ONION", "UNKNOWN"
IPV4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
LABEL = r"^[a-z0-9](?:[a-z0-9_-]{0,61}[a-z0-9])?$"


@lru_cache(1)
def _shipped(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    patterns = spark._jvm.com.google.thirdparty.publicsuffix.PublicSuffixPatterns
    rows = []
    for kind in ("EXACT", "UNDER", "EXCLUDED"):
        keys = spark._jvm.java.util.ArrayList(getattr(patterns, kind).keySet()).toString()
        rows += [(s, kind) for s in keys[1:-1].split(", ") if s]
    return tuple(sorted(rows))


def suffix_rules(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """(tld, exact, under, excluded): the rules of each top-level domain."""
    flat = spark.createDataFrame(list(rows if rows is not None else _shipped(spark)), "suffix string, kind string")
    by = [F.collect_list(F.when(F.col("kind") == k, F.col("suffix"))).alias(f"__{k.lower()}") for k in ("EXACT", "UNDER", "EXCLUDED")]
    return flat.groupBy(F.substring_index("suffix", ".", -1).alias("__tld")).agg(*by)


def _index(labels: Column) -> Column:
    """How many labels stand before the public suffix; null without one, or if an exclusion or wildcard leaves none."""
    exact, under, excluded = F.col("__exact"), F.col("__under"), F.col("__excluded")

    def at(i: Column) -> Column:
        suffix = F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
        return (
            F.when((i > 0) & F.array_contains(under, suffix), i - 1)
            .when(F.array_contains(exact, suffix), i)
            .when(F.array_contains(excluded, suffix), i + 1)
        )

    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), at), lambda i: i.isNotNull()), F.lit(0))


def with_host_kind(df: DataFrame, host: str = "host", out: str = "host_kind", rules: DataFrame | None = None) -> DataFrame:
    """``df`` with the kind of each host; null and empty hosts are UNKNOWN."""
    rules = suffix_rules(df.sparkSession) if rules is None else rules
    low = F.lower(F.col(host))
    name = F.regexp_replace(low, r"\.$", "")
    labels = F.split(name, r"\.", -1)
    valid = (F.length(name) <= 253) & F.forall(labels, lambda p: p.rlike(LABEL)) & ~F.element_at(labels, -1).rlike("^[0-9]")
    joined = df.withColumn("__tld", F.substring_index(name, ".", -1)).join(F.broadcast(rules), "__tld", "left")
    index = F.when(valid & F.col("__exact").isNotNull(), _index(labels))
    kind = (
        F.when(F.col(host).isNull() | (F.col(host) == ""), UNKNOWN)
        .when(F.col(host).rlike(IPV4), IP)
        .when(F.endswith(low, F.lit(".onion")), ONION)
        .when(index == 1, REGISTRABLE)
        .when(index > 1, SUBDOMAIN)
        .otherwise(UNKNOWN)
    )
    return joined.withColumn(out, kind).drop("__tld", "__exact", "__under", "__excluded")
