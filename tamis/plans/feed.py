"""A derived feed with every kind of indicator, made by the same SQL in any engine.

The driver's pages carry URLs only; the feed adds a marker, defanged addresses,
hashes, duplicates, odd cases, an existing list and arrival times, all from
``page_id`` and ``url``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.sources.tables import spread

_ID = "CAST(page_id AS STRING)"
_HOST = "regexp_extract(url, '://([^/:?#]*)', 1)"
_NL = "chr(10)"
_IP = "concat('10.', CAST(page_id % 250 AS STRING), '.', CAST(page_id % 7 AS STRING), '.1')"

FEED = f"""
SELECT page_id AS doc_id, concat(
  CASE WHEN page_id % 6 = 5 THEN 'early.example.com' ELSE 'preface' END, {_NL},
  'Письмо ФСТЭК России от 01.01.2026', chr(160), '№  240/93/', {_ID}, {_NL},
  replace(replace(url, 'http', 'hxxp'), '.', '[.]'), {_NL},
  replace(CASE WHEN page_id % 4 = 0 THEN upper({_HOST}) ELSE {_HOST} END, '.', '[.]'), ' ', {_HOST}, ';', {_NL},
  replace({_IP}, '.', '[.]'), ', 192[.]168[.]', CAST(page_id % 200 AS STRING), '.7:8080/Load[.]exe', {_NL},
  md5(url), ' ', upper(sha1(url)), {_NL},
  CASE WHEN page_id % 3 = 0 THEN concat('БИБ-', {_ID}, {_NL}) ELSE '' END,
  {{sha256}}, {_NL},
  {_HOST}, '/Path/File.html?x=1 user[at]', {_HOST}, ' payload(dot)exe 1.2.3.4: 999.1.1.1', {_NL},
  CASE WHEN page_id % 5 = 0 THEN concat('abcdefghij', {_ID}, 'x.onion', {_NL}) ELSE '' END,
  'https://evil.example.com/', md5(url), ' адресexample.org "hxxps[:]//', {_HOST}, '/A?b=C"', {_NL},
  CASE WHEN page_id % 2 = 0 THEN concat({_HOST}, ' ', {_IP}, ' example.com') ELSE 'example.net/x' END
) AS text FROM pages
"""
#: Every fifth page's address, host and hashes are listed already.
LOOKUP = f"""
SELECT 'masks' AS artifact, 'mask' AS kind, lower({_HOST}) AS key, CAST(page_id + 10 AS STRING) AS id FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'ip_list', 'ip', {_IP}, CAST(page_id + 600 AS STRING) FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'hashes', 'hash_md5', upper(md5(url)), CASE WHEN page_id % 10 = 0 THEN 'n/a' ELSE CAST(page_id + 10000 AS STRING) END FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'hashes', 'hash_sha1', upper(sha1(url)), NULL FROM pages WHERE page_id % 5 = 0
"""
#: Four sources with times of arrival, one of them unknown.
SOURCES = """
SELECT page_id AS doc_id, concat('s', CAST(page_id % 4 AS STRING)) AS source_key,
  CASE WHEN page_id % 4 = 2 THEN NULL WHEN page_id % 4 = 1 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2026-01-02 00:00:00' END AS detected_at FROM pages
"""
DUCK = {"sha256": "sha256(url)"}
SPARK = {"sha256": "sha2(url, 256)"}


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**SPARK).replace("FROM pages", "FROM {pages}"), pages=spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FEED)


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, LOOKUP)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SOURCES)
