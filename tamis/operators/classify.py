"""Address features and first-match classification."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import RULES, Rule
from tamis.functions import psl, text
from tamis.operators.registry import PREDICATES


def with_features(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds host, has_port, has_path, has_query, host_kind and bare_ip to rows with type and value."""
    rest = text.without_scheme(text.normalise(F.col("value")))
    out = df.withColumn("__rest", rest).withColumn("__authority", text.authority(F.col("__rest")))
    out = out.select(
        *df.columns,
        text.host(F.col("__authority")).alias("host"),
        text.has_port(F.col("__authority")).alias("has_port"),
        F.contains("__rest", F.lit("/")).alias("has_path"),
        F.contains("__rest", F.lit("?")).alias("has_query"),
    )
    out = psl.with_host_kind(out, "host", "host_kind", rules)
    bare = (F.col("type") == "IPV4") & (F.col("host_kind") == psl.IP) & ~F.col("has_port") & ~F.col("has_path") & ~F.col("has_query")
    return out.withColumn("bare_ip", bare)


def first_match(rules: Iterable[Rule], code: str) -> Column:
    """Code (url_match or host_match) of the first rule whose predicates all hold; null without one, or for a blank code."""
    out: Column | None = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, (PREDICATES[p]() for p in rule.when), F.lit(True))
        value = getattr(rule, code)
        value = F.lit(value if value and value.strip() else None).cast("string")
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return F.lit(None).cast("string") if out is None else out


def classified(df: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Adds url_match and host_match to rows with features."""
    return df.withColumn("url_match", first_match(rules, "url_match")).withColumn("host_match", first_match(rules, "host_match"))
