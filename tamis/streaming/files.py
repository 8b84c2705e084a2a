"""A Structured Streaming form of ingestion, for inboxes in any store.

Files are read by the built-in stream. A batch waits until its files have been
left alone for the quiet period and reads them then; what can't be read is tried
again, and goes to a table of failures with its reason when the attempts are used
up. New sources are those whose content hash the table of keys lacks; it is laid
out by the first digits of the hash, so a batch reads only the parts that its own
keys can be in. Rows go to a table by day and batch. A batch that runs again
overwrites what it wrote, and its keys come last, so a crash loses and doubles
nothing. Files of no bytes are passed over by the built-in reader.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tamis.config import Config
from tamis.plans.extraction import featured, indicators, retained
from tamis.sources.documents import texts
from tamis.sources.tables import exists, forget, materialise

#: Fixed value: the schema of the binary reader.
BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Beside the table of indicators: the keys of all sources, and the sources that could not be read.
KEYS, FAILED = "-keys", "-failed"


def file_stream(spark: SparkSession, inbox: str, config: Config) -> DataFrame:
    """New files by name pattern, so many a trigger; excluded names are dropped."""
    c = config.ingestion
    endings = ",".join(c.include)
    options = {"maxFilesPerTrigger": c.max_files_per_poll, **({"pathGlobFilter": f"{{{endings}}}"} if endings else {})}
    rows = spark.readStream.format("binaryFile").schema(BINARY).options(**options).load(inbox)
    for pattern in c.exclude:
        wild = "^" + pattern.replace(".", r"\.").replace("*", "[^/]*").replace("?", "[^/]") + "$"
        rows = rows.where(~F.regexp_extract("path", r"[^/]*$", 0).rlike(wild))
    return rows


def settled(files: DataFrame, quiet_seconds: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> list[str]:
    """Paths of a batch of files (so many as a poll takes) that still exist, once none has changed for the quiet period."""
    spark, known = files.sparkSession, {r["path"]: r["at"] for r in files.select("path", F.col("modificationTime").cast("double").alias("at")).collect()}
    while known and (left := max(known.values()) + quiet_seconds - now()) > 0:
        sleep(left)
        known = {p: a for p, a in known.items() if exists(spark, p)}
        known = {r["path"]: r["at"] for r in spark.read.format("binaryFile").load(list(known)).select("path", F.col("modificationTime").cast("double").alias("at")).collect()} if known else {}
    return sorted(known)


def documents_of(spark: SparkSession, paths: list[str], config: Config, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The files as text, a row each; those with an error are read again as often as the configuration says."""
    c, done, left = config.ingestion, None, paths
    for attempt in range(1, max(1, c.max_attempts) + 1):
        read = materialise(texts(spark.read.format("binaryFile").load(left), config.charset))
        left = [r["path"] for r in read.where("error is not null").select("path").collect()]
        last = not left or attempt == max(1, c.max_attempts)
        part = read if last else read.where("error is null")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        sleep(c.backoff_seconds)
    return done


def indicator_partitions(documents: DataFrame, config: Config, lookup: DataFrame | None = None) -> DataFrame:
    """Retained, classified indicators of readable documents, with source_key and day; copies in a batch count once."""
    first = documents.where("error is null").groupBy("source_key").agg(F.min_by(F.struct("text", "modified"), "path").alias("d")).select("source_key", "d.text", "d.modified")
    rows = indicators(first.withColumn("day", F.date_format("modified", "yyyy-MM-dd")), config, "source_key", "day")
    return featured(retained(rows, config, lookup, "source_key"), config)


def _part(key: str) -> Column:
    return F.substring(key, 1, 2).alias("part")


def ingest_stream(
    spark: SparkSession, inbox: str, table: str, checkpoint: str, config: Config | None = None, lookup: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep
) -> DataStreamWriter:
    """A writer that is ready to start; choose a trigger."""
    config = config or Config()

    def save(rows: DataFrame, path: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def batch(files: DataFrame, batch_id: int) -> None:
        paths = settled(files, config.ingestion.quiet_seconds, sleep)
        if not paths:
            return
        documents = materialise(documents_of(spark, paths, config, sleep).withColumn("batch", F.lit(batch_id)))
        keys = documents.select("source_key", "path", "modified", F.expr("if(error is null, 'READ', 'FAILED')").alias("status"), "batch", _part("source_key"))
        fresh = documents
        if exists(spark, table + KEYS):  # sources of an earlier batch are duplicates; this batch's own are overwritten
            parts = [r["part"] for r in keys.select("part").distinct().collect()]  # 256 at most
            seen = spark.read.schema(keys.schema).parquet(table + KEYS).where(F.col("part").isin(parts) & (F.col("batch") < batch_id) & (F.col("status") == "READ"))
            fresh = documents.join(seen.select("source_key").distinct(), "source_key", "left_anti")
        rows = materialise(indicator_partitions(fresh, config, lookup).withColumn("batch", F.lit(batch_id)))
        save(rows, table, "day", "batch")
        save(documents.where("error is not null").select("source_key", "path", "modified", "error", "batch"), table + FAILED, "batch")
        save(keys, table + KEYS, "part", "batch")
        forget(documents, rows)

    return file_stream(spark, inbox, config).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
