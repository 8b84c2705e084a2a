"""Extraction against a model, and its edge cases."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tamis.config import PATTERNS, PRIORITY, Config
from tamis.functions.arrays import count_before, sums_before
from tamis.operators.dedup import first_in_source, not_listed
from tamis.operators.extract import exploded, with_indicators
from tamis.plans.extraction import indicators


def model(text):
    """Claims on characters, type by type."""
    claimed, out = [False] * len(text), []
    for kind in PRIORITY:
        for m in re.finditer(PATTERNS[kind].replace(r"\s", r"\t\n\f\r "), text, re.ASCII):
            if not any(claimed[m.start() : m.end()]):
                claimed[m.start() : m.end()] = [True] * (m.end() - m.start())
                out.append((m.start(), kind, m[0]))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, refanged string")
    out = {i: [] for i in range(len(texts))}
    for r in exploded(with_indicators(df), "doc_id").orderBy("doc_id", "ordinal").collect():
        out[r["doc_id"]].append((r["start"], r["type"], r["value"]))
    return out


def test_random_documents(spark):
    rng = random.Random(11)
    parts = ["a" * 32, "0123456789abcdef" * 2, "f" * 40, "e" * 64, "http://", "https://", "evil.com", "sub.evil.co.uk", "1.2.3.4", "999.1.1.1", ":80", "/a/b", "?q=1", " ", "\n", ";", ",", '"', "'", "\u00a0", "адрес", "\x0b", ".", "x", "-", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == model(t), t


def test_edge_cases(spark):
    md5 = "d41d8cd98f00b204e9800998ecf8427e"
    texts = [f"https://evil.com/{md5}", "1.2.3.4567", "example.com:8080/x", "john.doe@x.com", "адресexample.com", "", "https://evil.com/x evil.com"]
    got = {i: [(k, v) for _, k, v in rows] for i, rows in found(spark, texts).items()}
    assert got[0] == [("MD5", md5)]
    assert got[1] == [("IPV4", "1.2.3.456")]
    assert got[2] == [("DOMAIN", "example.com")]
    assert got[3] == [("DOMAIN", "john.doe"), ("DOMAIN", "x.com")]
    assert got[4] == [("DOMAIN", "example.com")]
    assert got[5] == []
    assert got[6] == [("URL", "https://evil.com/x"), ("DOMAIN", "evil.com")]


def test_very_many_matches_in_one_text(spark):
    rng = random.Random(5)
    words = ["a.com", "http://b.org/x", "1.2.3.4", "c" * 32, "http://sub.d.net", "БИБ-1", "none"]
    text = " ".join(rng.choice(words) for _ in range(120_000))
    began = time.monotonic()
    rows = indicators(spark.createDataFrame([(1, text)], "doc_id long, text string"), Config(), "doc_id").orderBy("start").collect()
    assert time.monotonic() - began < 60
    assert len(rows) > 80_000 and [(r["start"], r["type"], r["value"]) for r in rows] == model(text)
    label, at = [], 0
    marks = [m.start() for m in re.finditer("БИБ-1", text)]
    for r in rows:
        while at < len(marks) and marks[at] <= r["start"]:
            at += 1
        label.append("БИБ-1" if at else "UNKNOWN")
    assert [r["source_label"] for r in rows] == label


def test_sums_and_places(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = list(range(n))
        df = spark.createDataFrame([(values, [(v * 2,) for v in values])], "v array<int>, s array<struct<start:int>>")
        r = df.select(sums_before(F.col("v")).alias("sums"), *[count_before(F.col("s"), F.lit(x)).alias(f"c{x + 1}") for x in (-1, 0, 7, 10_000)]).first()
        assert r["sums"] == [sum(values[:i]) for i in range(n)]
        assert [r[f"c{x + 1}"] for x in (-1, 0, 7, 10_000)] == [sum(v * 2 < x for v in values) for x in (-1, 0, 7, 10_000)]


def test_null_text_has_no_indicators(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert indicators(df, Config(), "doc_id").count() == 0


def test_attribution(spark):
    text = "a.com БИБ-1 b.com Письмо ФСТЭК России от\n1 №  2/3 c.com БИБ-2d.com"
    rows = indicators(spark.createDataFrame([(1, text)], "doc_id long, text string"), Config(), "doc_id").orderBy("start").collect()
    assert [(r["value"], r["source_label"]) for r in rows] == [("a.com", "UNKNOWN"), ("b.com", "БИБ-1"), ("c.com", "Письмо ФСТЭК России от 1 № 2/3"), ("2d.com", "БИБ-2")]


def test_types_without_pattern_are_skipped(spark):
    df = spark.createDataFrame([(1, "1.2.3.4 a.com")], "doc_id long, refanged string")
    assert [r["type"] for r in exploded(with_indicators(df, patterns={"DOMAIN": PATTERNS["DOMAIN"]}), "doc_id").collect()] == ["DOMAIN"]


def test_first_wins(spark):
    rows = spark.createDataFrame([(1, 0, "DOMAIN", "A.com", "x"), (1, 1, "DOMAIN", "a.com", "y"), (1, 2, "DOMAIN", "A.com", "z"), (2, 0, "DOMAIN", "A.com", "w")], "doc_id long, ordinal int, type string, value string, source_label string")
    kept = first_in_source(rows, "doc_id").orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["value"], r["source_label"]) for r in kept] == [(1, "A.com", "x"), (1, "a.com", "y"), (2, "A.com", "w")]


@pytest.mark.parametrize(("kind", "value", "listed"), [("DOMAIN", "Evil.com", True), ("IPV4", "1.2.3.4", True), ("IPV4", "1.2.3.4:80", False), ("MD5", "aa", True), ("SHA1", "aa", False)])
def test_lookup(spark, kind, value, listed):
    lookup = spark.createDataFrame([("mask", "evil.com"), ("ip", "1.2.3.4"), ("hash_md5", "AA"), ("mask", None)], "kind string, key string")
    rows = spark.createDataFrame([(kind, value)], "type string, value string")
    assert (not_listed(rows, lookup).count() == 0) == listed
