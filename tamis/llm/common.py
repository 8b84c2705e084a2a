"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this and than the given part of a partition's even share.
LEAST_HOT, HOT_SHARE = 500, 0.25
#: Rows and bytes in an Arrow batch: a Python worker holds one batch of whole texts at a time (one text more where it alone is larger).
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, opened by Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_remainder(name: str, mod: int) -> Column:
    """crc32 of the id in decimal, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``BATCH_BYTES`` bytes, so that long texts don't fill a worker."""
    for key, most, usual in (("maxRecordsPerBatch", rows, 10_000), ("maxBytesPerBatch", BATCH_BYTES, 1 << 28)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name, str(usual)))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + _own_folder()


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tamis-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def materialise(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor rereads files instead of recomputing) and
    makes later passes cheap. The table is deleted when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamis-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` wrote and nobody needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tamis-" in path:
            _forget(df.sparkSession, path)


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, in which ``key`` is unique, where few keys may hold much of ``left``.

    Keys with more than a part of a partition's even share of the ``total`` rows of ``left`` are found by a
    pre-aggregated count. There can be partitions / HOT_SHARE of them at most, so their rows of ``right`` are
    broadcast and those of ``left`` stay where they are; the rest is shuffled. Null keys find nothing.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(LEAST_HOT, int(HOT_SHARE * total / parts))
    if total <= least:
        return left.join(right, key, how)
    found = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(key).collect()
    if not found:
        return left.join(right, key, how)
    hot = F.broadcast(spark.createDataFrame(found, left.select(key).schema))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))
