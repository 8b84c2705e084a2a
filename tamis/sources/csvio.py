"""The CSV dialect of the lists: every value quoted, NULL bare, CRLF."""

from __future__ import annotations

import csv
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.config import Csv
from tamis.sources.tables import exists


def cell(value: Column, dialect: Csv) -> Column:
    q = dialect.quote
    return F.coalesce(F.concat(F.lit(q), F.replace(value.cast("string"), F.lit(q), F.lit(q + q)), F.lit(q)), F.lit(dialect.null_literal))


def line(columns: Iterable[str], dialect: Csv | None = None) -> Column:
    """One row as text, without its line end."""
    dialect = dialect or Csv()
    return F.concat_ws(dialect.delimiter, *[cell(F.col(c), dialect) for c in columns])


def header(columns: Iterable[str], dialect: Csv | None = None) -> str:
    dialect = dialect or Csv()
    q = dialect.quote
    return dialect.delimiter.join(q + c.replace(q, q + q) + q for c in columns)


def write_file(df: DataFrame, path: str, columns: list[str], order: str = "__row", dialect: Csv | None = None) -> int:
    """One file in row order, replaced atomically; the header is written even for no rows. Returns the rows.

    Rows stream through the driver partition by partition, so its memory does not grow with the list.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    rows = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(header(columns, dialect) + "\r\n")
            for r in df.orderBy(order).select(line(columns, dialect).alias("line")).toLocalIterator():
                f.write(r["line"] + "\r\n")
                rows += 1
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return rows


def write_directory(df: DataFrame, path: str, columns: list[str], dialect: Csv | None = None) -> None:
    """The same lines as a directory of files, for lists too large for one."""
    df.select(line(columns, dialect).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_list(df: DataFrame, path: str, columns: list[str], *, dialect: Csv | None = None) -> int:
    """One file, or a directory of files where the dialect says that a list of so many rows is too large for the driver."""
    limit = (dialect or Csv()).largest_file
    if limit:
        rows = df.count()
        if rows > limit:
            write_directory(df, path, columns, dialect)
            return rows
    return write_file(df, path, columns, dialect=dialect)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, dialect: Csv | None = None) -> DataFrame:
    """All columns as nullable strings; a missing file has the given columns and no rows."""
    dialect = dialect or Csv()
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    options = {"sep": dialect.delimiter, "quote": dialect.quote, "escape": dialect.quote, "header": True, "nullValue": dialect.null_literal, "emptyValue": "", "multiLine": True}
    df = spark.read.options(**options).csv(path)
    if columns is None:
        return df
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_rows(path: str, dialect: Csv | None = None) -> list[dict[str, str | None]]:
    """A small file on the driver, for indexes and tests."""
    dialect = dialect or Csv()
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", newline="") as f:
        return [{k: None if v == dialect.null_literal else v for k, v in row.items()} for row in csv.DictReader(f, delimiter=dialect.delimiter, quotechar=dialect.quote)]
