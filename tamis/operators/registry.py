"""Named extension points: predicates, value providers, transforms, row keys and merge policies.

Each name maps to a function that builds a Column, so a configuration compiles
into a plan without user-defined functions. Add to a mapping to extend it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import psl, text
from tamis.operators.dedup import first_by

#: Predicates of classification rules, over the columns that ``features`` adds.
PREDICATES: dict[str, Callable[[], Column]] = {
    "has-query": lambda: F.col("has_query"),
    "has-path": lambda: F.col("has_path"),
    "has-port": lambda: F.col("has_port"),
    "has-path-or-port": lambda: F.col("has_path") | F.col("has_port"),
    "is-ip": lambda: F.col("host_kind") == psl.IP,
    "is-registrable": lambda: F.col("host_kind") == psl.REGISTRABLE,
    "is-subdomain": lambda: F.col("host_kind") == psl.SUBDOMAIN,
    "is-onion": lambda: F.col("host_kind") == psl.ONION,
}
#: Artifact filters know one predicate more.
ARTIFACT_PREDICATES: dict[str, Callable[[], Column]] = {**PREDICATES, "is-bare-ip": lambda: F.col("bare_ip")}

#: Value providers: what a column holds before gate and transforms.
PROVIDERS: dict[str, Callable[[str | None], Column]] = {
    "const": lambda literal: F.lit(literal).cast("string"),
    "id": lambda _: F.col("__id").cast("string"),
    "value": lambda _: F.col("value"),
    "source.label": lambda _: F.col("source_label"),
    "match.url": lambda _: F.col("url_match"),
    "match.host": lambda _: F.col("host_match"),
    "address.url": lambda _: F.when(~F.col("bare_ip"), F.col("value")),
    "address.ip": lambda _: F.when(F.col("bare_ip"), F.col("value")),
}

#: Transforms: value and argument (what follows the first colon) to value.
TRANSFORMS: dict[str, Callable[[Column, str], Column]] = {
    "lower": lambda v, _: F.lower(v),
    "upper": lambda v, _: F.upper(v),
    "lower-host": lambda v, _: text.lower_host(v),
    "strip-prefix": lambda v, arg: text.strip_prefix(v, arg),
}

#: Ways to make a row's key.
KEY_MODES = text.KEY_MODES

#: Which of the rows with one __key is appended: rows with __key, detected_at, source_key and ordinal to at most one for each key.
MERGE_POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {"keep-first": first_by("detected_at", "source_key", "ordinal")}
