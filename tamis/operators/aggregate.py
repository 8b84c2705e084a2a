"""Aggregation of sources into canonical lists: keep-first merge with stable ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.config import Merge
from tamis.functions.text import row_key
from tamis.operators.registry import MERGE_POLICIES
from tamis.operators.sequence import numbered
from tamis.sources.tables import materialise

INDEX_SCHEMA = "artifact string, key string, id long, created_at timestamp, updated_at timestamp"


class Lists(Mapping[str, DataFrame]):
    """Lists by name, each planned when it is asked for."""

    def __init__(self, plans: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._plans, self._made = dict(plans), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._plans[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


@dataclass
class Aggregated:
    """Outcome of an aggregation; everything but the counters is a DataFrame."""

    artifacts: Mapping[str, DataFrame]  # the artifact's columns and __row, its order
    index: DataFrame
    counters: DataFrame  # a row per artifact


def keyed(rows: DataFrame, merge: Merge) -> DataFrame:
    return rows.withColumn("__key", row_key(merge.key_columns, merge.key_mode))


def aggregate(
    canonical: Mapping[str, DataFrame],
    arrived: Mapping[str, DataFrame],
    index: DataFrame,
    merges: Iterable[Merge],
    only: Iterable[str] = (),
    *,
    global_ids: bool = True,
) -> Aggregated:
    """Merge ``arrived`` into ``canonical``.

    canonical: rows of each artifact and __row; all of them stay, first, as they are.
    arrived: rows of each artifact and detected_at, source_key, ordinal. The first row of
    a key that the canonical list lacks is appended, with the id that ``index`` has for
    artifact and key, or the next new one: one counter for all artifacts from 1 (or one
    for each, if not ``global_ids``), counted up in order of artifact and arrival.
    """
    wanted = set(only)
    active = [m for m in merges if not wanted or m.name in wanted]
    fresh: dict[str, DataFrame] = {}
    keys: DataFrame | None = None
    for rank, m in enumerate(active):
        known = keyed(canonical[m.name], m).select("__key").where("__key is not null").distinct()
        fresh[m.name] = materialise(MERGE_POLICIES[m.conflict_policy](keyed(arrived[m.name], m)).join(known, "__key", "left_anti"))
        part = fresh[m.name].select(F.lit(m.name).alias("artifact"), F.lit(rank).alias("rank"), F.col("__key").alias("key"), "detected_at", "source_key", "ordinal")
        keys = part if keys is None else keys.unionByName(part)
    spark = index.sparkSession
    if keys is None:
        return Aggregated({}, index, spark.createDataFrame([], "artifact string"))
    missing = keys.join(index.select("artifact", "key"), ["artifact", "key"], "left_anti")
    order = ["rank", F.col("detected_at").asc_nulls_last(), "source_key", "ordinal"]
    placed = numbered(missing, order, "__n")
    top = index.groupBy("artifact").agg(F.max("id").alias("__top"))
    if global_ids:
        start = (index.agg(F.max("id")).first()[0] or 0) + 1
        created = placed.withColumn("id", F.lit(start) + F.col("__n"))
    else:
        own = placed.groupBy("artifact").agg(F.min("__n").alias("__first"))  # an artifact's numbers are consecutive
        created = placed.join(own, "artifact").join(top, "artifact", "left").withColumn("id", F.coalesce("__top", F.lit(0)) + 1 + F.col("__n") - F.col("__first"))
    now = F.current_timestamp()
    created = materialise(created.select("artifact", "key", F.col("id").cast("long").alias("id"), now.alias("created_at"), now.alias("updated_at")))
    whole = index.unionByName(created)

    def merged(m: Merge) -> DataFrame:
        old = canonical[m.name]
        columns = [c for c in old.columns if c != "__row"]
        ids = whole.where(F.col("artifact") == m.name).select(F.col("key").alias("__key"), F.col("id").alias("__new_id"))
        rows = fresh[m.name].join(ids, "__key")
        if "id" in columns:
            rows = rows.withColumn("id", F.col("__new_id").cast("string"))
        first = old.agg(F.max("__row")).first()[0] if old.columns else None
        rows = numbered(rows, [F.col("detected_at").asc_nulls_last(), "source_key", "ordinal"], "__row").withColumn("__row", F.col("__row") + F.lit((first if first is not None else -1) + 1))
        return old.select(*columns, F.col("__row").cast("long").alias("__row")).unionByName(rows.select(*columns, F.col("__row").cast("long").alias("__row")))

    # One aggregate over a row for everything that is counted.
    def counted(name: str, rows: DataFrame, kind: str, key: str | None = None) -> DataFrame:
        return rows.select(F.lit(name).alias("artifact"), F.lit(kind).alias("kind"), (F.col(key).isNull() if key else F.lit(False)).alias("keyless"))

    facts = created.select("artifact", F.lit("created").alias("kind"), F.lit(False).alias("keyless"))
    for m in active:
        facts = facts.unionByName(counted(m.name, keyed(arrived[m.name], m), "read", "__key")).unionByName(counted(m.name, keyed(canonical[m.name], m), "old", "__key")).unionByName(counted(m.name, fresh[m.name], "fresh"))
    number = lambda condition: F.count(F.when(F.expr(condition), 1))
    sums = facts.groupBy("artifact").agg(
        number("kind = 'read'").alias("rows_read"), number("kind = 'old' or kind = 'fresh'").alias("rows_written"), number("kind = 'created'").alias("new_ids"),
        (number("kind = 'read' and not keyless") - number("kind = 'fresh'")).alias("unchanged"), number("keyless").alias("skipped"),
    )
    names = spark.createDataFrame([(i, m.name) for i, m in enumerate(active)], "place int, artifact string")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums.columns[1:]]
    counters = names.join(sums, "artifact", "left").orderBy("place").select("artifact", *zero)
    return Aggregated(Lists({m.name: partial(merged, m) for m in active}), whole, counters)
