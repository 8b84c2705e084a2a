"""Indicator extraction: all matches with offsets, and claims by priority.

Everything happens inside a row, so extraction neither shuffles nor leaves the
JVM. Offsets follow from the matches and the gaps between them. A match is kept
if it overlaps no kept match of a type before its own; the kept ones are disjoint
and in order, so a binary search finds the only one that can overlap, and a text
with very many matches takes no square of their number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import PRIORITY, Config
from tamis.functions import text as fn
from tamis.functions.arrays import count_before, once, sums_before
from tamis.functions.dialect import ascii_dialect, plain_dialect

SPAN = "array<struct<start:int,end:int,value:string>>"
TYPED = "array<struct<start:int,end:int,type:string,value:string>>"


def find_all(text: Column, pattern: str, engine: str = "re2j") -> Column:
    """All non-overlapping leftmost matches, left to right: array of (start, end, value), in code points."""
    own = ascii_dialect(pattern, engine)
    native = F.lit(plain_dialect(pattern, engine))
    # In a text without other characters the engine's own boundaries mean the same and are quicker.
    regex = F.when(F.octet_length(text) == F.char_length(text), native).otherwise(F.lit(own))
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.split(text, regex, -1)  # no default pattern matches the empty text, so one gap more than matches

    def placed(both: Column) -> Column:
        pairs = F.arrays_zip(both["hits"].alias("hit"), F.slice(both["gaps"], F.lit(1), F.size(both["hits"])).alias("gap"))
        sizes = F.transform(pairs, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), x["hit"].alias("value")))

        def spans(sized: Column) -> Column:
            before = sums_before(F.transform(sized, lambda x: x["gap"] + x["hit"]))
            zipped = F.arrays_zip(sized.alias("x"), before.alias("before"))
            return F.transform(zipped, lambda z: F.struct((z["before"] + z["x"]["gap"]).alias("start"), (z["before"] + z["x"]["gap"] + z["x"]["hit"]).alias("end"), z["x"]["value"].alias("value")))

        return once(sizes, spans)

    spans = once(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)
    return F.when(F.rlike(text, regex), spans).otherwise(F.array().cast(SPAN))


def _free(kept: Column, s: Column) -> Column:
    """Whether ``s`` overlaps none of ``kept``, which are disjoint and in order."""
    return once(count_before(kept, s["end"]), lambda n: (n == 0) | (F.get(kept, n - 1)["end"] <= s["start"]))


def with_indicators(df: DataFrame, text_col: str = "refanged", patterns: Mapping[str, str] | None = None, engine: str = "re2j", out: str = "indicators") -> DataFrame:
    """``df`` with the array of indicators (start, end, type, value), ordered by start.

    Types come in their fixed priority, whatever the order of ``patterns``; types
    without a pattern are skipped. Matches that lose claim nothing.
    """
    patterns = Config().patterns if patterns is None else patterns
    kinds = [t for t in PRIORITY if patterns.get(t)]
    if not kinds:
        return df.withColumn(out, F.array().cast(TYPED))

    def typed(kind: str, text: Column) -> Column:
        return F.transform(find_all(text, patterns[kind], engine), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("type"), s["value"].alias("value")))

    # A fold over the types, by priority: the kept ones are a variable of the fold, not a column
    # that the optimiser would copy into every comparison.
    def claim(kept: Column, own: Column) -> Column:
        return F.array_sort(F.concat(kept, F.filter(own, lambda s: _free(kept, s))))

    def claimed(text: Column) -> Column:
        return F.aggregate(F.array(*[typed(k, text) for k in kinds]), F.array().cast(TYPED), claim)

    return df.withColumn(out, once(F.col(text_col), claimed))


def extract(df: DataFrame, config: Config | None = None, text_col: str = "text") -> DataFrame:
    """Refang ``text_col`` and find indicators and markers: adds refanged, indicators and markers."""
    from tamis.operators.attribute import markers

    config = config or Config()
    refanged = df.withColumn("refanged", fn.refang(F.col(text_col), config.refang))
    return with_indicators(refanged, "refanged", config.patterns, config.engine).withColumn("markers", once(F.col("refanged"), lambda t: markers(t, config.markers, config.engine)))


def placed_rows(df: DataFrame, array: Column | str, out: str, *keep: str) -> DataFrame:
    """(keep..., ordinal, ``out``): a row an element.

    The outer form, because for the inner one the optimiser adds a filter that computes the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("ordinal", out)).where("ordinal is not null")


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """One row per indicator: the columns ``keep``, ordinal (0, 1, ...), start, end, type, value, and source_label if there."""
    rows = placed_rows(df, "indicators", "i", *keep)
    own = [F.col(f"i.{f.name}").alias(f.name) for f in rows.schema["i"].dataType.fields]
    return rows.select(*keep, "ordinal", *own)
