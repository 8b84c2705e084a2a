"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and two joins over the links. Aggregations combine
before the shuffle; a hub, at which much of the links meet, is found by a count
and joined where its links are. Nothing is gathered on the driver but one
checksum and the few hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import forget, join_hot, materialise


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return join_hot(both.where("b > a"), least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_hot(down, least, "a", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)``, any order, to ``(node, root)``: root is the smallest node reachable.

    Nodes without a link to another node are absent. Rounds go on until the links
    no longer change; each is written to the shared folder. Null ends are ignored.
    """
    now = materialise(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, old = mark, now
        large = materialise(_large_star(old, mark["n"]))
        now = materialise(_small_star(large, mark["n"]))
        forget(old)
        forget(large)
