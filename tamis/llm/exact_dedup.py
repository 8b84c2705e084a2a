"""Exact duplicates by content sort.

Sampled splitters range-partition the leading bytes of the normalised text, the
shuffle's external sort brings equal texts next to each other, and a window
compares neighbours on the whole normalised text.

Keys that many rows share (one text copied everywhere) are found first by a
pre-aggregated count of (prefix, length). Their rows get a salt, so that the
range partitioner may cut such a run in several; each cut run elects its own
head, and only the heads, a few rows, meet again to elect the survivor.

Everything is DataFrame code. Defined cases: null text counts as empty, so all
empty texts form one group; null ids sort last; rows repeated with the same id
and text are one group of which one row stays; an empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the splitters, and the share of a partition's rows from which a key counts as heavy.
PREFIX, HEAVY_SHARE, LEAST_HEAVY = 64, 0.25, 500


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, whole_rows: bool = False) -> DataFrame:
    """Per row of ``df``: id, keep_id, group_size, kept, text_sha256; with ``whole_rows`` also the row, as the struct __row.

    Equal means identical after lower-casing A-Z; the largest id stays.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = "__row" if whole_rows else "__text"
    text = text_of("__row." + text_col) if whole_rows else F.col("__text")
    rows = df.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row") if whole_rows else text_of(text_col).alias("__text"))
    keyed = rows.select(
        "doc_id", carried,
        ascii_lower(F.substring(text, 1, PREFIX)).alias("__prefix"),
        F.octet_length(text).alias("__bytes"),
    )

    counts = keyed.groupBy("__prefix", "__bytes").agg(F.count("*").alias("__n"))
    # At most parts / HEAVY_SHARE keys of PREFIX characters can hold more than this share.
    total = df.select(F.lit(1)).count()
    least = max(LEAST_HEAVY, int(HEAVY_SHARE * total / parts))
    heavy = counts.where(F.col("__n") > least).select("__prefix", "__bytes", F.ceil(F.col("__n") / least).cast("int").alias("__splits"))
    salted = (
        keyed.join(F.broadcast(heavy), ["__prefix", "__bytes"], "left")
        .withColumn("__salt", F.when(F.col("__splits").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("__splits").cast("long")).cast("int")).otherwise(F.lit(-1)))
        .drop("__splits")
    )

    def sorted_runs(rows: DataFrame, *more: str) -> DataFrame:
        """Neighbouring rows of a partition compared on the whole text; the first of a run is its head."""
        placed = rows.repartitionByRange(parts, "__prefix", "__bytes", "__salt")
        full = placed.select("doc_id", "__prefix", "__bytes", "__salt", ascii_lower(text).alias("__norm"), *more)
        run = Window.partitionBy("__prefix", "__bytes", "__salt", "__norm")
        ordered = run.orderBy(F.col("doc_id").desc_nulls_last())
        return full.select(
            "doc_id", "__salt",
            F.row_number().over(ordered).alias("__place"),
            F.first("doc_id").over(ordered).alias("__head"),
            F.count(F.lit(1)).over(run).alias("__size"),
            F.sha2(F.col("__norm").cast("binary"), 256).alias("text_sha256"),
            "__norm", *more,
        )

    runs = sorted_runs(salted, *(["__row"] if whole_rows else []))
    # Only heads of cut runs: at most twice parts / HEAVY_SHARE rows and one per other text in a heavy key.
    heads = sorted_runs(salted.where("__salt >= 0")).where("__place = 1")
    merged = (
        heads.groupBy("__norm")
        .agg(F.max("__head").alias("__top"), F.sum("__size").alias("__all"), F.collect_set("__salt").alias("__salts"))
        .select(F.explode("__salts").alias("__salt"), F.sha2(F.col("__norm").cast("binary"), 256).alias("text_sha256"), "__top", "__all")
    )
    joined = runs.drop("__norm").join(merged, ["__salt", "text_sha256"], "left")
    keep, first = F.when(F.col("__all").isNotNull(), F.col("__top")).otherwise(F.col("__head")), F.col("__place") == 1
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("__all", "__size").cast("long").alias("group_size"),
        (first & F.col("__head").eqNullSafe(keep)).alias("kept"),
        "text_sha256", *(["__row"] if whole_rows else []),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with their columns; they travel with the sort, so there is no join.

    A null id loses to any other; of a group with null ids only, one row stays.
    """
    return exact_dedup(df, id_col, text_col, whole_rows=True).where("kept").select("__row.*")
