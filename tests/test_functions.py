"""Case tables of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tamis.config import REFANG
from tamis.functions import psl, text
from tamis.functions.dialect import ascii_dialect
from tamis.operators.classify import classified, with_features
from tamis.operators.registry import TRANSFORMS


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("given", "expected"), [("hxxps[:]//evil[.]com/a", "https://evil.com/a"), ("1[.]2[.]3[.]4", "1.2.3.4"), ("hxxps hxxp", "https http"), ("plain text", "plain text"), ("a(dot)b[at]c", "a.b@c"), ("HXXP", "HXXP"), ("", ""), (None, None)])
def test_refang(spark, given, expected):
    assert one(spark, given, lambda v: text.refang(v, REFANG)) == expected


@pytest.mark.parametrize(("given", "expected"), [("voffice.top;", "voffice.top"), ('  "x.com" ', "x.com"), ("a.b,", "a.b"), ("a.b/c", "a.b/c"), ("a.b.", "a.b."), ("\r\n\tx'", "x")])
def test_normalise(spark, given, expected):
    assert one(spark, given, text.normalise) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("HTTPS://Evil.COM/Path?Q=A", "https://evil.com/Path?Q=A"), ("Evil.com?A=B", "evil.com?A=B"), ("EVIL.com", "evil.com"), ("A.b/C://D", "a.b/c://d"), ("", "")],
)
def test_lower_host(spark, given, expected):
    assert one(spark, given, text.lower_host) == expected


def test_transforms(spark):
    assert one(spark, "Письмо X", lambda v: TRANSFORMS["strip-prefix"](v, "Письмо ")) == "X"
    assert one(spark, "XПисьмо ", lambda v: TRANSFORMS["strip-prefix"](v, "Письмо ")) == "XПисьмо "
    assert one(spark, "aБ", lambda v: TRANSFORMS["upper"](v, "")) == "AБ"
    assert one(spark, "AБ", lambda v: TRANSFORMS["lower"](v, "")) == "aб"


@pytest.mark.parametrize(("given", "expected"), [(" 12 ", 12), ("x", 0), (None, 0), ("", 0), ("-3", -3)])
def test_parse_id(spark, given, expected):
    assert one(spark, given, text.parse_id) == expected


def test_row_keys(spark):
    rows = spark.createDataFrame([(" a ", "b"), ("null", "b"), (None, None), ("", "NULL")], "Hash_MD5 string, hash_sha1 string")
    composite = [r[0] for r in rows.select(text.row_key(["Hash_MD5", "hash_sha1"], "composite")).collect()]
    first = [r[0] for r in rows.select(text.row_key(["Hash_MD5", "hash_sha1"], "first-non-empty")).collect()]
    assert composite == ["hash_md5:a|hash_sha1:b", None, None, None]
    assert first == ["hash_md5:a", "hash_sha1:b", None, None]


FEATURES = [
    ("example.com", "DOMAIN", "example.com", False, False, False, "REGISTRABLE", False),
    ("sub.example.com", "DOMAIN", "sub.example.com", False, False, False, "SUBDOMAIN", False),
    ("1.2.3.4", "IPV4", "1.2.3.4", False, False, False, "IP", True),
    ("1.2.3.4:8080", "IPV4", "1.2.3.4", True, False, False, "IP", False),
    ("1.2.3.4/a", "IPV4", "1.2.3.4", False, True, False, "IP", False),
    ("1.2.3.4:", "IPV4", "1.2.3.4:", False, False, False, "UNKNOWN", False),
    ("http://1.2.3.4", "URL", "1.2.3.4", False, False, False, "IP", False),
    ("https://x.example.com:443/p?q=1", "URL", "x.example.com", True, True, True, "SUBDOMAIN", False),
    ("http://user@example.com", "URL", "user@example.com", False, False, False, "UNKNOWN", False),
    ("abc.onion", "DOMAIN", "abc.onion", False, False, False, "ONION", False),
    ("payload.exe", "DOMAIN", "payload.exe", False, False, False, "UNKNOWN", False),
    ("duckdns.org", "DOMAIN", "duckdns.org", False, False, False, "UNKNOWN", False),
    ("x.duckdns.org", "DOMAIN", "x.duckdns.org", False, False, False, "REGISTRABLE", False),
    ("a.b.ck", "DOMAIN", "a.b.ck", False, False, False, "REGISTRABLE", False),
    ("www.ck", "DOMAIN", "www.ck", False, False, False, "REGISTRABLE", False),
    ("EXAMPLE.com.", "DOMAIN", "EXAMPLE.com.", False, False, False, "REGISTRABLE", False),
    ("", "DOMAIN", "", False, False, False, "UNKNOWN", False),
]


def test_features(spark):
    rows = spark.createDataFrame([(f[0], f[1]) for f in FEATURES], "value string, type string")
    got = {r["value"]: r for r in with_features(rows).collect()}
    for value, kind, host, port, path, query, host_kind, bare in FEATURES:
        r = got[value]
        assert (r["type"], r["host"], r["has_port"], r["has_path"], r["has_query"], r["host_kind"], r["bare_ip"]) == (kind, host, port, path, query, host_kind, bare), value


def test_host_kinds_against_the_library(spark):
    """The suffix table decides like the library that it comes from."""
    names = spark._jvm.com.google.common.net.InternetDomainName
    hosts = ["a.co.uk", "co.uk", "b.a.co.uk", "x.github.io", "github.io", "city.kawasaki.jp", "a.kawasaki.jp", "b.a.kawasaki.jp", "com", "a_b.com", "-x.com", "x.1com", "a.b.c.d.e.org", "xn--p1ai", "x.xn--p1ai", "ck", "foo.bar", "1.example.com"]

    def expected(host):
        if not names.isValid(host):
            return "UNKNOWN"
        name = names.__getattr__("from")(host)
        return "REGISTRABLE" if name.isTopPrivateDomain() else "SUBDOMAIN" if name.isUnderPublicSuffix() else "UNKNOWN"

    got = {r["host"]: r["host_kind"] for r in psl.with_host_kind(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {h: expected(h) for h in hosts}


@pytest.mark.parametrize(
    ("value", "kind", "url", "host"),
    [
        ("example.com", "DOMAIN", "u:hAS", "h:dAS"), ("a.example.com", "DOMAIN", "u:hEX", "h:dEX"), ("example.com/a", "DOMAIN", "u:hEX,dEX", None), ("example.com/a?b", "DOMAIN", "u:hAS,pEX", None),
        ("1.2.3.4:80", "IPV4", "u:hEX,dEX", None), ("x.onion", "DOMAIN", "u:hAS", "h:dAS"), ("1.2.3.4", "IPV4", "u:hAS", "h:dAS"),
    ],
)
def test_match_codes(spark, value, kind, url, host):
    r = classified(with_features(spark.createDataFrame([(value, kind)], "value string, type string"))).first()
    assert (r["url_match"], r["host_match"]) == (url, host)


def test_dialect():
    assert ascii_dialect(r"\bx\b", "jdk") == r"\bx\b"
    assert ascii_dialect(r"[^\s;]\s") == "[^\\t\\n\\f\\r ;][\\t\\n\\f\\r ]"
    assert "(?<=" in ascii_dialect(r"\bx")
    with pytest.raises(ValueError):
        ascii_dialect("a" * 3000)


def test_marker_label(spark):
    assert one(spark, " Письмо \u00a0 №\n 1 ", text.marker_label) == "Письмо № 1"
