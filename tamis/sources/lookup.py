"""Lookups: the keys and ids of existing lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import Csv
from tamis.sources import csvio

#: Fixed value: columns that hold keys; addresses are compared in lower case, hashes in upper case.
KEYS = {"mask": "lower", "ip": "lower", "hash_md5": "upper", "hash_sha1": "upper", "hash_sha256": "upper"}
SCHEMA = "artifact string, kind string, key string, id string"


def entries(spark: SparkSession, lists: Mapping[str, str], dialect: Csv | None = None) -> DataFrame:
    """(artifact, kind, key, id) of all lists; a row with several hashes gives several, one without keys a null key."""
    out = spark.createDataFrame([], SCHEMA)
    for name, path in lists.items():
        rows = csvio.read(spark, path, None, dialect)
        if not rows.columns:
            continue
        found = [F.struct(F.lit(c).alias("kind"), F.expr(f"{case}(trim(`{c}`))").alias("key")) for c, case in KEYS.items() if c in rows.columns]
        keys = F.filter(F.array(*found), lambda k: k["key"].isNotNull() & (k["key"] != "")) if found else F.array().cast("array<struct<kind:string,key:string>>")
        ident = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
        one = rows.select(F.lit(name).alias("artifact"), F.explode_outer(keys).alias("k"), ident.alias("id"))
        out = out.unionByName(one.select("artifact", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), "id"))
    return out


def masks_only(spark: SparkSession, path: str, dialect: Csv | None = None) -> DataFrame:
    """The older form: masks alone, for any type of indicator."""
    return csvio.read(spark, path, ["mask"], dialect).select(F.lower("mask").alias("mask")).where("trim(mask) <> ''").distinct()
