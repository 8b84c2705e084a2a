"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only where all runs on one machine, as in tests."""
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


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path in whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the program ends."""
    path = f"{shared_folder(spark)}/tamis-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    atexit.register(clear)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back; the files go when the program ends, or by ``forget``."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``materialise`` wrote and nobody needs any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tamis-" in path:
                delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it comes in fewer pieces, as a small file does; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
