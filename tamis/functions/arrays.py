"""Arrays inside a row: sums of what comes before, and places in an order, in less than quadratic time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block: an array is copied for each element of its block, then once a block.
BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` a lambda variable, computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints what ``combine``, which is associative and has 0 as a start, makes of those before it."""

    def block(part: Column) -> Column:
        empty = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, empty, lambda s, v: F.struct(combine(s["all"], v).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")))

    def joined(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: block(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
        empty = F.struct(F.lit(0).alias("all"), F.array().cast("array<array<int>>").alias("out"))
        shifted = F.aggregate(blocks, empty, lambda s, b: F.struct(combine(s["all"], b["all"]).alias("all"), F.concat(s["out"], F.array(F.transform(b["before"], lambda x: combine(s["all"], x)))).alias("out")))
        return F.flatten(shifted["out"])

    return once(values, joined)


def sums_before(values: Column) -> Column:
    """For each of the ints the sum of those before it."""
    return running(values, lambda a, b: a + b)


def largest_before(values: Column) -> Column:
    """For each of the ints, none below 0, the largest of those before it; 0 for the first."""
    return running(values, F.greatest)


def count_before(spans: Column, place: Column, field: str = "start") -> Column:
    """How many of ``spans``, which are ordered by ``field``, have it below ``place``: a binary search.

    ``spans`` must be a lambda variable or a stored column, or each step computes it again.
    """
    state = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.get(spans, middle)[field] < place
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.when(F.size(spans) > 0, F.aggregate(steps, state, step)["low"]).otherwise(F.lit(0))
