"""Consecutive numbers in a global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.sources.tables import materialise


def numbered(df: DataFrame, order: list[Column | str], out: str = "n") -> DataFrame:
    """``df`` with 0, 1, ... in ``order``, which must tell rows apart.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the rows of the partitions before (one count a partition).
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = materialise(placed)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, rows = 0, []
    for r in counts:
        rows.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(rows, "__part long, __before long")
    return held.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + place).drop("__at", "__part", "__before")
