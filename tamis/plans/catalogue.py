"""Queries over the driver's tables, one or more an operator, with SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import ARTIFACTS, MARKERS, MERGES, PATTERNS, PRIORITY, REFANG, TYPES, Config
from tamis.functions import text as fn
from tamis.operators import attribute, dedup
from tamis.operators.aggregate import INDEX_SCHEMA, Aggregated, aggregate
from tamis.operators.artifacts import filled
from tamis.operators.extract import exploded, extract, find_all, placed_rows, with_indicators
from tamis.plans import diagnostics, feed
from tamis.plans.extraction import featured, indicators, retained
from tamis.sources import csvio, documents, ledger
from tamis.sources.tables import materialise, scratch, spread
from tamis.streaming.files import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Config()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _refanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.feed(spark, sf_dir).select("doc_id", fn.refang(F.col("text"), REFANG).alias("refanged"))


def refang_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refanged(spark, sf_dir)


def matches(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed_rows(_refanged(spark, sf_dir), find_all(F.col("refanged"), PATTERNS[kind]), "m", "doc_id")
    return rows.groupBy("doc_id", F.col("m.value").alias("value")).agg(F.count("*").alias("n"), F.min("m.start").cast("long").alias("first_pos"))


def document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed_rows(_table(spark, sf_dir, "documents"), find_all(F.coalesce("text", F.lit("")), PATTERNS["IPV4"]), "m", "doc_id")
    return docs.groupBy(F.col("m.value").alias("value")).agg(F.count("*").alias("n"))


def _spans(df: DataFrame) -> DataFrame:
    rows = exploded(with_indicators(df), "doc_id")
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("start").cast("long").alias("pos"), F.col("end").cast("long").alias("end_pos"), "type", "value")


def indicator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_refanged(spark, sf_dir))


def document_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_table(spark, sf_dir, "documents").select("doc_id", fn.refang(F.coalesce("text", F.lit("")), REFANG).alias("refanged")))


def conversation_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return _spans(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), fn.refang(F.coalesce("text", F.lit("")), REFANG).alias("refanged")))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators(feed.feed(spark, sf_dir), CONFIG, "doc_id")


def attributed_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("doc_id", F.col("start").cast("long").alias("pos"), "type", "value", "source_label")


def asof_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(feed.feed(spark, sf_dir), CONFIG)
    rows = exploded(found, "doc_id").select("doc_id", "start", "type", "value")
    marks = placed_rows(found, "markers", "m", "doc_id").select("doc_id", "m.*")
    return attribute.asof_labels(rows, marks).select("doc_id", F.col("start").cast("long").alias("pos"), "type", "value", "source_label")


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(_attributed(spark, sf_dir), CONFIG)


def indicator_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("doc_id", F.col("start").cast("long").alias("pos"), "type", "host", "has_port", "has_path", "has_query", "bare_ip")


def host_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).where("type in ('URL', 'IPV4', 'DOMAIN')").groupBy("host", "host_kind").agg(F.count("*").alias("n"))


def mask_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).where("type in ('URL', 'IPV4', 'DOMAIN')").groupBy("value", "url_match", "host_match").agg(F.count("*").alias("n"))


def stix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(t, c, s) for t, c, s in TYPES], "type string, category string, stix_type string")
    return _attributed(spark, sf_dir).join(F.broadcast(kinds), "type").groupBy("category", "stix_type").agg(F.count("*").alias("n"))  # six rows


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_in_source(_attributed(spark, sf_dir), "doc_id").select("doc_id", F.col("start").cast("long").alias("pos"), "type", "value", "source_label", fn.dedup_key(F.col("type"), F.col("value")).alias("dedup_key"))


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(_attributed(spark, sf_dir), CONFIG, feed.lookup(spark, sf_dir), "doc_id")


def dedup_lookup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).select("doc_id", F.col("start").cast("long").alias("pos"), "type", "value")


def lookup_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.max_ids(feed.lookup(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str, name: str, *keep: str) -> DataFrame:
    tops = {r["artifact"]: r["max_id"] for r in lookup_max_id(spark, sf_dir).collect()}  # a row a list
    return filled(featured(materialise(_retained(spark, sf_dir)), CONFIG), CONFIG.artifact(name), tops, keep=keep)


def artifact(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, name).drop("__row")


def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.operators.artifacts import routed

    rows = featured(materialise(_retained(spark, sf_dir)), CONFIG)
    out = None
    for a in ARTIFACTS:
        one = routed(rows, a).agg(F.count("*").alias("n")).select(F.lit(a.name).alias("artifact"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def csv_lines_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filled(spark, sf_dir, "masks")
    return rows.select(csvio.line([c.name for c in CONFIG.artifact("masks").columns]).alias("line"))


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = featured(materialise(_retained(spark, sf_dir)), CONFIG), None
    for m in MERGES:
        one = filled(rows, CONFIG.artifact(m.name)).select(F.lit(m.name).alias("artifact"), fn.row_key(m.key_columns, m.key_mode).alias("row_key"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("artifact", "row_key").agg(F.count("*").alias("n"))


def _aggregated(spark: SparkSession, sf_dir: str) -> Aggregated:
    rows = materialise(featured(retained(_attributed(spark, sf_dir), CONFIG, None, "doc_id"), CONFIG))
    canonical, arrived = {}, {}
    for m in MERGES:
        a = CONFIG.artifact(m.name)
        columns = [c.name for c in a.columns]
        own = filled(rows, a, keep=("doc_id", "ordinal"))
        canonical[m.name] = own.where("doc_id % 10 = 0" if m.name == "masks" else "false").select(*columns, "__row")
        order = (F.col("doc_id") * 100_000 + F.col("ordinal")).cast("long").alias("ordinal")
        arrived[m.name] = own.select("doc_id", *columns, order).join(feed.sources(spark, sf_dir), "doc_id").drop("doc_id")
    return aggregate(canonical, arrived, spark.createDataFrame([], INDEX_SCHEMA), MERGES)


def aggregate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark, sf_dir).artifacts["masks"].groupBy("mask").agg(F.count("*").alias("n"), F.max("url_match").alias("url_match"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark, sf_dir).index.select("artifact", "key", "id")


def aggregation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark, sf_dir).counters


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", fn.source_key(F.coalesce("text", F.lit("")).cast("binary")).alias("source_key"))
    return docs.groupBy("source_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("deliveries"))


_LEDGER = "SELECT concat('k', CAST(page_id AS STRING)) AS key, CASE page_id % 7 WHEN 0 THEN 'CLAIMED' WHEN 1 THEN 'PARTITION_WRITTEN' WHEN 2 THEN 'LEDGER_RECORDED' WHEN 3 THEN 'AGGREGATED' WHEN 4 THEN 'FAILED' ELSE 'SOURCE_ARCHIVED' END AS status, page_id % 3 AS written, page_id AS seen FROM pages WHERE page_id % 11 <> 0"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed._run(spark, sf_dir, _LEDGER)
    return rows.withColumn("partitions", F.expr("if(written = 0, cast(array() as array<string>), array(key))")).withColumn("detected_at", F.timestamp_seconds("seen"))


def ledger_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ready(_ledger(spark, sf_dir)).select("key", "status")


def ledger_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.incomplete(_ledger(spark, sf_dir)).select("key", "status")


def ledger_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    processing = _table(spark, sf_dir, "pages").select(F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("key"), F.concat(F.lit("processing/k"), F.col("page_id").cast("string"), F.lit("-a.htm")).alias("path"))
    return ledger.orphans(processing, _ledger(spark, sf_dir)).select("key", "path")


def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return ledger.current(events)


def diagnostic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _attributed(spark, sf_dir).where("type = 'MD5'").select(F.lit("EXTRACTION.INDICATOR_SKIPPED").alias("code"), F.lit("DEBUG").alias("severity"), F.lit("EXTRACTION").alias("category"), F.create_map(F.lit("indicator"), F.col("value")).alias("context"))
    return diagnostics.rendered(found).groupBy("message").agg(F.count("*").alias("n"))


#: Fixed values of the public suffix list: suffixes, suffixes by a wildcard, and names that an exception makes registrable.
SUFFIXES = (("co.uk", "com.au", "github.io", "blogspot.com", "com", "museum"), ("x.ck", "y.bd"), ("www.ck", "city.kawasaki.jp"))


_SUFFIX_ROWS = ", ".join(f"('{s}', {depth})" for depth, group in ((0, SUFFIXES[0]), (0, SUFFIXES[1]), (1, SUFFIXES[2])) for s in group)
SUFFIX_HOSTS = f"SELECT concat(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('n', CAST(page_id AS STRING), '.') ELSE concat('a.n', CAST(page_id AS STRING), '.') END, suffix) AS host, depth + page_id % 3 AS depth FROM pages CROSS JOIN (VALUES {_SUFFIX_ROWS}) AS v(suffix, depth)"


def public_suffix_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts below plain, wildcard and exceptional suffixes, at three depths, made from the pages' ids."""
    from tamis.functions.psl import with_host_kind

    return with_host_kind(feed._run(spark, sf_dir, SUFFIX_HOSTS)).select("host", "host_kind")


def html_text_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the HTML reader, then domains; SQL has no parser."""
    files = _table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return indicators(documents.texts(files), CONFIG, "doc_id").groupBy("type", "value").agg(F.count("*").alias("n"))


def stream_ingest_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents in eight files, through the streaming source to a partitioned table."""
    base = scratch(spark)
    rows = feed.feed(spark, sf_dir).select(F.col("text").alias("value"), (F.col("doc_id") % 8).alias("file"))
    rows.repartition("file").write.partitionBy("file").option("lineSep", "\n").text(f"{base}/inbox")
    config = replace(CONFIG, ingestion=replace(CONFIG.ingestion, include=("*.txt",), quiet_seconds=0))
    ingest_stream(spark, f"{base}/inbox/*", f"{base}/table", f"{base}/checkpoint", config).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("type").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    "refang_feed": refang_feed,
    **{f"matches_{t.lower()}": partial(matches, t) for t in PRIORITY},
    "document_matches": document_matches,
    "indicator_spans": indicator_spans,
    "document_indicators": document_indicators,
    "conversation_indicators": conversation_indicators,
    "attributed_indicators": attributed_indicators,
    "asof_labels": asof_labels,
    "indicator_features": indicator_features,
    "host_kinds": host_kinds,
    "mask_matches": mask_matches,
    "stix_counts": stix_counts,
    "dedup_first": dedup_first,
    "dedup_lookup_anti": dedup_lookup_anti,
    "lookup_max_id": lookup_max_id,
    **{f"artifact_{a.name}": partial(artifact, a.name) for a in ARTIFACTS},
    "artifact_counts": artifact_counts,
    "csv_lines_masks": csv_lines_masks,
    "row_keys": row_keys,
    "aggregate_masks": aggregate_masks,
    "stable_ids": stable_ids,
    "aggregation_counters": aggregation_counters,
    "content_hash_dedup": content_hash_dedup,
    "ledger_ready": ledger_ready,
    "ledger_incomplete": ledger_incomplete,
    "ledger_orphans": ledger_orphans,
    "ledger_current": ledger_current,
    "diagnostic_messages": diagnostic_messages,
    "public_suffix_kinds": public_suffix_kinds,
    "html_text_domains": html_text_domains,
    "stream_ingest_partitions": stream_ingest_partitions,
}

# -- the same in SQL -----------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _refang_sql(column: str) -> str:
    for old, new in REFANG:
        column = f"replace({column}, {_q(old)}, {_q(new)})"
    return column


_FEED = f"feed AS ({feed.FEED.format(**feed.DUCK)}), t AS (SELECT doc_id, {_refang_sql('text')} AS refanged FROM feed)"


def _offsets(name: str, pattern: str) -> str:
    """CTE ``name(doc_id, pos, end_pos, value)`` of all matches in t."""
    p = _q(pattern)
    return f"""{name}_a AS (SELECT doc_id, regexp_extract_all(refanged, {p}) AS h, regexp_split_to_array(refanged, {p}) AS g FROM t WHERE regexp_matches(refanged, {p})),
{name}_b AS (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM {name}_a),
{name} AS (SELECT doc_id, h[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS pos,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT) AS end_pos FROM {name}_b)"""


def _spans_sql() -> str:
    """CTEs up to ``ind(doc_id, ordinal, pos, end_pos, type, value)`` from t."""
    ctes, kept = [], []
    for t in PRIORITY:
        ctes.append(_offsets(f"m_{t}", PATTERNS[t]))
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {k} k WHERE k.doc_id = m.doc_id AND k.pos < m.end_pos AND m.pos < k.end_pos)" for k in kept) or "true"
        ctes.append(f"k_{t} AS (SELECT m.doc_id, m.pos, m.end_pos, '{t}' AS type, m.value FROM m_{t} m WHERE {free})")
        kept.append(f"k_{t}")
    ctes.append("ind AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal, pos, end_pos, type, value FROM (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in kept) + "))")
    return ", ".join(ctes)


_SPANS = f"{_FEED}, {_spans_sql()}"
_LABEL = "trim(regexp_replace(replace(value, chr(160), ' '), '\\s+', ' ', 'g'))"
_MARKS = ", ".join(_offsets(f"k{i}", p) for i, p in enumerate(MARKERS)) + ", marks AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, {_LABEL} AS label FROM k{i}" for i in range(len(MARKERS))) + ")"
_ATTR = f"{_SPANS}, {_MARKS}, attr AS (SELECT i.*, coalesce(m.label, 'UNKNOWN') AS source_label FROM ind i ASOF LEFT JOIN marks m ON i.doc_id = m.doc_id AND i.pos >= m.pos)"
_FEAT = r"""f1 AS (SELECT *, trim(value, ';,"'' ' || chr(9) || chr(13) || chr(10)) AS norm FROM {rows}),
f2 AS (SELECT *, CASE WHEN position('://' IN norm) > 0 THEN substr(norm, position('://' IN norm) + 3) ELSE norm END AS rest FROM f1),
f3 AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS auth FROM f2),
f4 AS (SELECT *, regexp_matches(auth, '^[^:]*:[0-9]+$') AS has_port, contains(rest, '/') AS has_path, contains(rest, '?') AS has_query FROM f3),
f5 AS (SELECT *, CASE WHEN has_port THEN split_part(auth, ':', 1) ELSE auth END AS host FROM f4),
f6 AS (SELECT *, CASE WHEN host = '' THEN 'UNKNOWN' WHEN regexp_matches(host, '^([0-9]{1,3}\.){3}[0-9]{1,3}$') THEN 'IP' WHEN lower(host) LIKE '%.onion' THEN 'ONION'
  WHEN regexp_matches(lower(host), '^example\.(com|org|net)$') THEN 'REGISTRABLE' WHEN regexp_matches(lower(host), '^([a-z0-9-]+\.)+example\.(com|org|net)$') THEN 'SUBDOMAIN' ELSE 'UNKNOWN' END AS host_kind FROM f5),
feat AS (SELECT *, type = 'IPV4' AND host_kind = 'IP' AND NOT has_port AND NOT has_path AND NOT has_query AS bare_ip,
  CASE WHEN has_query THEN 'u:hAS,pEX' WHEN has_path OR has_port THEN 'u:hEX,dEX' WHEN host_kind = 'SUBDOMAIN' THEN 'u:hEX' ELSE 'u:hAS' END AS url_match,
  CASE WHEN has_query THEN NULL WHEN has_path OR has_port THEN NULL WHEN host_kind = 'SUBDOMAIN' THEN 'h:dEX' ELSE 'h:dAS' END AS host_match FROM f6)"""
_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, value ORDER BY pos) AS place FROM attr) WHERE place = 1)"
_ANTI = f"""listed AS ({feed.LOOKUP}), kept AS (SELECT * FROM firsts a WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE
  l.kind = CASE WHEN type = 'IPV4' AND NOT regexp_matches(value, '[:/?]') THEN 'ip' WHEN type IN ('IPV4', 'DOMAIN', 'URL') THEN 'mask' ELSE 'hash_' || lower(type) END
  AND l.key = CASE WHEN type IN ('IPV4', 'DOMAIN', 'URL') THEN lower(value) ELSE upper(value) END))"""
_TOPS = "tops AS (SELECT artifact, max(coalesce(try_cast(trim(id) AS BIGINT), 0)) AS max_id FROM listed GROUP BY artifact)"
_LOWER_HOST = "lower(regexp_extract({v}, '(?s)^(?:.*?://)?[^/?]*')) || substr({v}, length(regexp_extract({v}, '(?s)^(?:.*?://)?[^/?]*')) + 1)"
_NULLS = {c: "CAST(NULL AS VARCHAR)" for c in ("score", "time_last_seen", "time_first_seen", "threat_type", "description")}
_STRIP = "CASE WHEN starts_with(source_label, 'Письмо ') THEN substr(source_label, 8) ELSE source_label END"
_ROUTES = {"masks": "type IN ('IPV4', 'DOMAIN', 'URL') AND NOT bare_ip", "ip_list": "type = 'IPV4' AND bare_ip", "address_blacklist": "type IN ('IPV4', 'DOMAIN', 'URL')", "hashes": "type IN ('MD5', 'SHA1', 'SHA256')"}
_CELLS = {
    "masks": {"mask": _LOWER_HOST.format(v="value"), "url_match": "url_match", "host_match": "host_match", **_NULLS, "source": "source_label"},
    "ip_list": {"ip": "value", **_NULLS, "source": _STRIP},
    "address_blacklist": {"forbidden_url": f"CASE WHEN NOT bare_ip THEN {_LOWER_HOST.format(v='value')} END", "forbidden_ip": f"CASE WHEN bare_ip THEN {_LOWER_HOST.format(v='value')} END"},
    "hashes": {**{f"hash_{t.lower()}": f"CASE WHEN type = '{t}' THEN upper(value) END" for t in ("MD5", "SHA256", "SHA1")}, **_NULLS, "source": _STRIP},
}


def _artifact_sql(name: str, rows: str = "feat") -> str:
    cells = ", ".join(f"{v} AS {k}" for k, v in _CELLS[name].items())
    ident = "" if name == "address_blacklist" else f"CAST((SELECT coalesce(max(max_id), 0) FROM tops WHERE artifact = '{name}') + row_number() OVER (ORDER BY doc_id, ordinal) AS VARCHAR) AS id, "
    return f"SELECT {ident}{cells} FROM {rows} WHERE {_ROUTES[name]}"


_KEPT = f"WITH {_ATTR}, {_FIRST}, {_ANTI}, {_TOPS}, " + _FEAT.replace("{rows}", "kept")
_KEYS = {m.name: " || '|' || ".join(f"'{c}:' || {c}" for c in m.key_columns) if m.key_mode == "composite" else "coalesce(" + ", ".join(f"'{c}:' || {c}" for c in m.key_columns) + ")" for m in MERGES}


def _arrivals_sql() -> str:
    """CTEs: arr (all arrived rows with keys), canon (keys of the canonical masks), fresh (first arrivals that are new)."""
    parts = []
    for rank, m in enumerate(MERGES):
        cells = ", ".join(f"{v} AS {k}" for k, v in _CELLS[m.name].items())
        parts.append(f"SELECT '{m.name}' AS artifact, {rank} AS rank, doc_id, ordinal, {_KEYS[m.name]} AS key FROM (SELECT doc_id, ordinal, {cells} FROM feat WHERE {_ROUTES[m.name]})")
    return (
        f"WITH {_ATTR}, {_FIRST}, " + _FEAT.replace("{rows}", "firsts") + f", src AS ({feed.SOURCES}), keyed AS ({' UNION ALL '.join(parts)}), "
        "arr AS (SELECT k.*, s.source_key, s.detected_at FROM keyed k JOIN src s USING (doc_id)), "
        "canon AS (SELECT * FROM keyed WHERE artifact = 'masks' AND doc_id % 10 = 0), "
        "fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact, key ORDER BY detected_at NULLS LAST, source_key, doc_id, ordinal) AS place FROM arr a "
        "WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canon c WHERE c.artifact = a.artifact AND c.key = a.key)) WHERE place = 1)"
    )


_DOCS = f"t AS (SELECT doc_id, {_refang_sql('coalesce(text, chr(32))')} AS refanged FROM documents), {_spans_sql()}".replace("coalesce(text, chr(32))", "coalesce(text, '')")
_TURNS = f"t AS (SELECT conv_id * 1000 + turn AS doc_id, {_refang_sql('txt')} AS refanged FROM conversations), {_spans_sql()}".replace("txt", "coalesce(text, '')", 1)
_NETWORK = "type IN ('URL', 'IPV4', 'DOMAIN')"

ORACLES: dict[str, str] = {
    "refang_feed": f"WITH {_FEED} SELECT doc_id, refanged FROM t",
    **{f"matches_{t.lower()}": f"WITH {_FEED}, {_offsets('m', PATTERNS[t])} SELECT doc_id, value, count(*) AS n, min(pos) AS first_pos FROM m GROUP BY ALL" for t in PRIORITY},
    "document_matches": f"SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), {_q(PATTERNS['IPV4'])})) AS value FROM documents) GROUP BY value",
    "indicator_spans": f"WITH {_SPANS} SELECT doc_id, ordinal, pos, end_pos, type, value FROM ind",
    "document_indicators": f"WITH {_DOCS} SELECT doc_id, ordinal, pos, end_pos, type, value FROM ind",
    "conversation_indicators": f"WITH {_TURNS} SELECT doc_id, ordinal, pos, end_pos, type, value FROM ind",
    "attributed_indicators": f"WITH {_ATTR} SELECT doc_id, pos, type, value, source_label FROM attr",
    "asof_labels": f"WITH {_ATTR} SELECT doc_id, pos, type, value, source_label FROM attr",
    "indicator_features": f"WITH {_ATTR}, {_FEAT.replace('{rows}', 'attr')} SELECT doc_id, pos, type, host, has_port, has_path, has_query, bare_ip FROM feat",
    "host_kinds": f"WITH {_ATTR}, {_FEAT.replace('{rows}', 'attr')} SELECT host, host_kind, count(*) AS n FROM feat WHERE {_NETWORK} GROUP BY ALL",
    "mask_matches": f"WITH {_ATTR}, {_FEAT.replace('{rows}', 'attr')} SELECT value, url_match, host_match, count(*) AS n FROM feat WHERE {_NETWORK} GROUP BY ALL",
    "stix_counts": f"WITH {_ATTR}, k(type, category, stix_type) AS (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in TYPES)}) SELECT category, stix_type, count(*) AS n FROM attr JOIN k USING (type) GROUP BY ALL",
    "dedup_first": f"WITH {_ATTR}, {_FIRST} SELECT doc_id, pos, type, value, source_label, type || '|' || value AS dedup_key FROM firsts",
    "dedup_lookup_anti": f"WITH {_ATTR}, {_FIRST}, {_ANTI} SELECT doc_id, pos, type, value FROM kept",
    "lookup_max_id": f"WITH listed AS ({feed.LOOKUP}), {_TOPS} SELECT artifact, max_id FROM tops",
    **{f"artifact_{a.name}": f"{_KEPT} {_artifact_sql(a.name)}" for a in ARTIFACTS},
    "artifact_counts": f"{_KEPT} " + " UNION ALL ".join(f"SELECT '{a.name}' AS artifact, count(*) AS n FROM feat WHERE {_ROUTES[a.name]}" for a in ARTIFACTS),
    "csv_lines_masks": f"{_KEPT} SELECT concat_ws(';', " + ", ".join(f"coalesce('\"' || replace({c.name}, '\"', '\"\"') || '\"', 'NULL')" for c in CONFIG.artifact("masks").columns) + f") AS line FROM ({_artifact_sql('masks')})",
    "row_keys": f"{_KEPT} SELECT artifact, row_key, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{m.name}' AS artifact, {_KEYS[m.name]} AS row_key FROM ({_artifact_sql(m.name)})" for m in MERGES) + ") GROUP BY ALL",
    "aggregate_masks": f"{_arrivals_sql()}, m AS (SELECT doc_id, ordinal, url_match, {_LOWER_HOST.format(v='value')} AS mask FROM feat WHERE {_ROUTES['masks']}) SELECT mask, count(*) AS n, max(url_match) AS url_match FROM (SELECT m.mask, m.url_match FROM m WHERE doc_id % 10 = 0 UNION ALL SELECT m.mask, m.url_match FROM m JOIN fresh f ON f.artifact = 'masks' AND f.doc_id = m.doc_id AND f.ordinal = m.ordinal) GROUP BY mask",
    "stable_ids": f"{_arrivals_sql()} SELECT artifact, key, row_number() OVER (ORDER BY rank, detected_at NULLS LAST, source_key, doc_id, ordinal) AS id FROM fresh",
    "aggregation_counters": f"{_arrivals_sql()} SELECT artifact, count(*) AS rows_read, (SELECT count(*) FROM canon c WHERE c.artifact = arr.artifact) + (SELECT count(*) FROM fresh f WHERE f.artifact = arr.artifact) AS rows_written, (SELECT count(*) FROM fresh f WHERE f.artifact = arr.artifact) AS new_ids, count(key) - (SELECT count(*) FROM fresh f WHERE f.artifact = arr.artifact) AS unchanged, count(*) - count(key) AS skipped FROM arr GROUP BY artifact",
    "public_suffix_kinds": f"SELECT host, CASE depth WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'REGISTRABLE' ELSE 'SUBDOMAIN' END AS host_kind FROM ({SUFFIX_HOSTS})",
    "stream_ingest_partitions": f"WITH {_SPANS} SELECT type, count(*) AS n FROM (SELECT DISTINCT doc_id % 8, type, value FROM ind) GROUP BY type",
    "content_hash_dedup": "SELECT sha256(coalesce(text, '')) AS source_key, min(doc_id) AS doc_id, count(*) AS deliveries FROM documents GROUP BY 1",
    "ledger_ready": f"SELECT key, status FROM ({_LEDGER}) WHERE status = 'SOURCE_ARCHIVED' AND written <> 0",
    "ledger_incomplete": f"SELECT key, status FROM ({_LEDGER}) WHERE status NOT IN ('SOURCE_ARCHIVED', 'AGGREGATED', 'FAILED')",
    "ledger_orphans": "SELECT concat('k', CAST(page_id AS STRING)) AS key, concat('processing/k', CAST(page_id AS STRING), '-a.htm') AS path FROM pages WHERE page_id % 11 = 0",
    "ledger_current": "SELECT CAST(user_id AS STRING) AS key, max_by(event_type, event_id) AS status FROM events GROUP BY user_id",
    "diagnostic_messages": f"WITH {_ATTR} SELECT 'Indicator ' || value || ' was skipped: {{reason}}' AS message, count(*) AS n FROM attr WHERE type = 'MD5' GROUP BY value",
}
