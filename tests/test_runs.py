"""Whole runs: the golden lists, the daemon, aggregation."""

from __future__ import annotations

import io
import os
import zipfile
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamis import config as cfg
from tamis.operators import registry
from tamis.operators.aggregate import INDEX_SCHEMA, aggregate
from tamis.operators.dedup import first_by
from tamis.plans import diagnostics as dia
from tamis.plans.extraction import READ, extract_source, extraction_pipeline
from tamis.plans.kernel import envelope
from tamis.plans.ports import Ports
from tamis.sources import csvio, documents, ledger
from tamis.sources.inbox import ready_files
from tamis.sources.lookup import entries
from tamis.streaming.daemon import AlreadyRunning, Daemon

LABEL = "Письмо ФСТЭК России от 01.01.2026 № 240/93/0001"
LINES = [
    LABEL, "example[.]com", "sub[.]example[.]com", "1[.]2[.]3[.]4", "5[.]6[.]7[.]8:8080/Payload[.]exe", "example[.]com/Folder/File[.]exe", "example[.]com/x?Token=AbC",
    "hxxps[:]//example[.]com/Path/File[.]rar", "t[.]me/SomeChannel", "abcdefghijklmnop234567[.]onion", "d41d8cd98f00b204e9800998ecf8427e", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
]
HTML = '<html><head><meta charset="utf-8"></head><body>\n' + "\n".join(f"<p>{x}</p>" for x in LINES) + "\n</body></html>\n"
SHORT = LABEL.removeprefix("Письмо ")
NONE = ";NULL;NULL;NULL;NULL"
EXPECTED = {
    "masks_list_generated.csv": ['"id";"mask";"url_match";"host_match";"score";"time_last_seen";"time_first_seen";"threat_type";"source";"description"']
    + [
        f'"{i}";"{m}";"{u}";{h}{NONE};"{LABEL}";NULL'
        for i, (m, u, h) in enumerate(
            [
                ("example.com", "u:hAS", '"h:dAS"'), ("sub.example.com", "u:hEX", '"h:dEX"'), ("5.6.7.8:8080/Payload.exe", "u:hEX,dEX", "NULL"), ("example.com/Folder/File.exe", "u:hEX,dEX", "NULL"),
                ("example.com/x?Token=AbC", "u:hAS,pEX", "NULL"), ("https://example.com/Path/File.rar", "u:hEX,dEX", "NULL"), ("t.me/SomeChannel", "u:hEX,dEX", "NULL"), ("abcdefghijklmnop234567.onion", "u:hAS", '"h:dAS"'),
            ], 1,
        )
    ],
    "ip_list_generated.csv": ['"id";"ip";"score";"time_last_seen";"time_first_seen";"threat_type";"source";"description"', f'"1";"1.2.3.4"{NONE};"{SHORT}";NULL'],
    "hashes_list_generated.csv": [
        '"id";"hash_md5";"hash_sha256";"hash_sha1";"score";"time_last_seen";"time_first_seen";"threat_type";"source";"description"',
        f'"10024";"{LINES[10].upper()}";NULL;NULL{NONE};"{SHORT}";NULL', f'"10025";NULL;"{LINES[11].upper()}";NULL{NONE};"{SHORT}";NULL',
    ],
}


def settings(folder: Path, **more):
    artifacts = tuple(replace(a, id=cfg.IdSpec(start=10024)) if a.name == "hashes" else a for a in cfg.ARTIFACTS)
    ingestion = cfg.Ingestion(**{k: str(folder / k) for k in ("inbox", "processing", "done", "failed", "ledger", "partitions")}, quiet_seconds=0, backoff_seconds=0)
    return cfg.validated(cfg.Config(artifacts=artifacts, output_dir=str(folder / "out"), ingestion=ingestion, aggregation=cfg.Aggregation(id_index=str(folder / "index.csv")), **more))


def test_golden(spark, tmp_path):
    (tmp_path / "source.html").write_text(HTML, encoding="utf-8")
    config = settings(tmp_path)
    dry = extract_source(spark, str(tmp_path / "source.html"), config, dry_run=True)
    assert (dry.extracted, dry.retained, dry.written) == (11, 11, {}) and not (tmp_path / "out").exists()
    summary = extract_source(spark, str(tmp_path / "source.html"), config)
    assert str(summary).splitlines() == ["Extracted=11, retained=11", "masks=8", "ip_list=1", "address_blacklist=9", "hashes=2"]
    for name, lines in EXPECTED.items():
        assert (tmp_path / "out" / name).read_bytes().decode().split("\r\n") == [*lines, ""]
    black = (tmp_path / "out/address_blacklist_generated.csv").read_text(encoding="utf-8").splitlines()
    assert black[:4] == ['"forbidden_url";"forbidden_ip"', '"example.com";NULL', '"sub.example.com";NULL', 'NULL;"1.2.3.4"'] and len(black) == 10


def test_every_unread_and_empty_file_is_reported(spark, tmp_path):
    for i in range(25):
        (tmp_path / f"a{i}.pdf").write_bytes(b"%PDF-1.4")
        (tmp_path / f"b{i}.txt").write_text(" ")
    read = next(x for x in extraction_pipeline(spark, settings(tmp_path), dry_run=True).stages if x.name == READ)
    noted = read.apply(envelope(str(tmp_path), "x")).notification.diagnostics
    assert [d.code for d in noted] == ["SOURCE.UNSUPPORTED_FORMAT"] * 25 + ["SOURCE.EMPTY_TEXT"] * 25
    assert dia.fail_fast(read.apply(envelope(str(tmp_path / "b1.txt"), "x")).notification) is None


def test_daemon(spark, tmp_path):
    config = settings(tmp_path)
    daemon = Daemon(spark, config, sleep=lambda s: None)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.html").write_text(HTML, encoding="utf-8")
    (inbox / "b.tmp").write_text("x")
    (first,) = daemon.poll()
    assert first.status == ledger.SOURCE_ARCHIVED and len(first.partitions) == 4 and all(os.path.exists(p) for p in first.partitions)
    assert [p.name for p in inbox.iterdir()] == ["b.tmp"] and (tmp_path / "done" / f"{first.key}-a.html").exists()
    (inbox / "again.html").write_text(HTML, encoding="utf-8")
    (second,) = daemon.poll()
    assert second.duplicate and second.key == first.key and not (inbox / "again.html").exists()
    (inbox / "bad.docx").write_bytes(b"PK\x03\x04 broken")
    (third,) = daemon.poll()
    assert third.status == ledger.FAILED and list((tmp_path / "failed").glob("*.error"))
    (tmp_path / "processing").mkdir(exist_ok=True)
    (tmp_path / "processing" / "abc-orphan.html").write_text("x")
    assert [o.status for o in daemon.recover_incomplete()] == [ledger.FAILED]

    counters = {c["artifact"]: c for c in daemon.aggregate()}
    assert counters["masks"] == {"artifact": "masks", "rows_read": 8, "rows_written": 8, "new_ids": 8, "unchanged": 0, "skipped": 0}
    assert counters["hashes"]["rows_written"] == 2 and daemon.aggregate() is None
    ids = csvio.read_rows(str(tmp_path / "index.csv"))
    assert [int(r["id"]) for r in ids] == list(range(1, 21)) and ids[0]["key"] == "mask:example.com" and ids[9]["artifact"] == "address_blacklist"
    assert [r["id"] for r in csvio.read_rows(str(tmp_path / "out/hashes_list_generated.csv"))] == ["19", "20"]

    (inbox / "c.html").write_text("<p>EXAMPLE.com new.example.org</p>", encoding="utf-8")
    daemon.poll()
    counters = {c["artifact"]: c for c in daemon.aggregate(("masks",))}
    assert set(counters) == {"masks"} and counters["masks"] == {"artifact": "masks", "rows_read": 2, "rows_written": 9, "new_ids": 1, "unchanged": 1, "skipped": 0}
    masks = csvio.read_rows(str(tmp_path / "out/masks_list_generated.csv"))
    assert [m["mask"] for m in masks][-1] == "new.example.org" and masks[-1]["id"] == "21" and masks[0]["id"] == "1"
    assert daemon.health()["up"]
    daemon._lock.acquire()
    with pytest.raises(AlreadyRunning):
        daemon.aggregate()


@pytest.mark.parametrize("status", [ledger.CLAIMED, ledger.PARTITION_WRITTEN, ledger.LEDGER_RECORDED])
def test_recovery(spark, tmp_path, status):
    daemon = Daemon(spark, settings(tmp_path))
    (tmp_path / "processing").mkdir()
    path = tmp_path / "processing" / "k1-a.html"
    path.write_text("<p>a.example.com</p>", encoding="utf-8")
    daemon.ledger.mark("k1", status, original_path="a.html", processing_path=str(path), detected_at=ledger.now())
    (out,) = daemon.recover_incomplete()
    assert out.status == ledger.SOURCE_ARCHIVED and (tmp_path / "done/k1-a.html").exists() and not path.exists()
    assert bool(out.partitions) == (status == ledger.CLAIMED)


def test_aggregation_keeps_first(spark):
    columns = "id string, mask string"
    canonical = {"masks": spark.createDataFrame([("7", "a", 0), ("8", "a", 1), ("9", None, 2)], f"{columns}, __row long")}
    rows = [("1", "a", None, "s", 0), ("1", "b", "2026-01-02 00:00:00", "s", 1), ("5", "b", "2026-01-01 00:00:00", "t", 0), ("6", "c", None, "a", 0), ("6", "NULL", None, "a", 1)]
    arrived = {"masks": spark.createDataFrame(rows, f"{columns}, d string, source_key string, ordinal long").selectExpr("id", "mask", "cast(d as timestamp) detected_at", "source_key", "ordinal")}
    index = spark.createDataFrame([("masks", "mask:c", 40, None, None)], INDEX_SCHEMA)
    out = aggregate(canonical, arrived, index, [cfg.MERGES[0]])
    assert [(r["id"], r["mask"]) for r in out.artifacts["masks"].orderBy("__row").collect()] == [("7", "a"), ("8", "a"), ("9", None), ("41", "b"), ("40", "c")]
    assert out.counters.first().asDict() == {"artifact": "masks", "rows_read": 5, "rows_written": 5, "new_ids": 1, "unchanged": 2, "skipped": 2}


def test_lookup_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id;hash_md5;hash_sha256;hash_sha1\r\n100;aaaa;NULL;\r\nx;NULL;NULL;BB\r\n", encoding="utf-8")
    (tmp_path / "m.csv").write_text('"id";"mask"\r\n"10";"Example.com"\r\n', encoding="utf-8")
    rows = entries(spark, {"hashes": str(tmp_path / "h.csv"), "masks": str(tmp_path / "m.csv"), "gone": str(tmp_path / "none.csv")}).collect()
    assert {(r["artifact"], r["kind"], r["key"], r["id"]) for r in rows} == {("hashes", "hash_md5", "AAAA", "100"), ("hashes", "hash_sha1", "BB", "x"), ("masks", "mask", "example.com", "10")}


def test_csv_dialect(spark, tmp_path):
    df = spark.createDataFrame([('a"b', None, 0), ("line\nfeed", ";", 1)], "x string, y string, __row long")
    path = str(tmp_path / "o.csv")
    assert csvio.write_file(df, path, ["x", "y"]) == 2
    assert Path(path).read_bytes() == b'"x";"y"\r\n"a""b";NULL\r\n"line\nfeed";";"\r\n'
    assert [tuple(r) for r in csvio.read(spark, path).collect()] == [('a"b', None), ("line\nfeed", ";")]
    assert csvio.read(spark, str(tmp_path / "none.csv"), ["x"]).collect() == []


def test_inbox_filter(tmp_path):
    for name, age in (("a.htm", 20), ("b.html", 5), ("c.tmp", 20), (".d.htm", 20), ("e.docx", 30)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 - age, 1000 - age))
    c = cfg.Ingestion()
    assert [os.path.basename(p) for p in ready_files(str(tmp_path), c.include, c.exclude, 10, now=1000)] == ["e.docx", "a.htm"]
    assert len(ready_files(str(tmp_path), (), (), 0, limit=2, now=1000)) == 2


def test_documents(spark, tmp_path):
    (tmp_path / "w.html").write_bytes('<p>Привет</p><script>x.com</script><table><tr><td>a</td><td>b&amp;c</td></tr></table>'.encode("cp1251"))
    (tmp_path / "t.txt").write_text("plain", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>')
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>evil.com</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<ws><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></ws>')
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4")
    rows = {os.path.basename(r["path"]): r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["w.html"]["text"].split() == ["Привет", "a", "b&c"] and "x.com" not in rows["w.html"]["text"]
    assert rows["t.txt"]["text"] == "plain" and rows["d.docx"]["text"] == "one\ntwo" and rows["s.xlsx"]["text"] == "evil.com\t5"
    assert rows["p.pdf"]["text"] is None and "PDF" in rows["p.pdf"]["error"]


def office(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def test_more_formats_and_own_readers(spark, tmp_path):
    slide = lambda t: f'<s xmlns:a="x"><a:p><a:t>{t}</a:t></a:p></s>'
    files = {
        "a.pptx": office({"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide("ten.com"), "ppt/slides/slide2.xml": slide("two.com")}),
        "b.odt": office({"mimetype": "x", "content.xml": '<d xmlns:t="x"><t:h>head</t:h><t:p>odt<t:span>.com</t:span></t:p></d>'}),
        "c.rtf": rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}{\*\generator x;}rtf.com\par \'c0\u1041?\{x\}}",
        "d.eml": b"Subject: mail.com\r\nContent-Type: text/html\r\n\r\n<p>body.com</p>",
        "e.pdf": b"%PDF-1.4 own.com",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    own = lambda name, content: content[9:].decode() if name.endswith(".pdf") else None
    rows = {os.path.basename(r["path"]): r["text"] for r in documents.read_documents(spark, str(tmp_path), readers=[own]).collect()}
    assert rows == {"a.pptx": "two.com\nten.com", "b.odt": "head\nodt.com", "c.rtf": "rtf.com\nАБ{x}", "d.eml": "mail.com\nbody.com", "e.pdf": "own.com"}


def test_ports_can_be_replaced(spark, tmp_path):
    held = {}

    def read(spark, path, charset):
        return spark.createDataFrame([(path, path, "k", None, "port.com", None)], "doc_id string, path string, source_key string, modified timestamp, text string, error string")

    def write(rows, path, columns, *, dialect):
        held[os.path.basename(path)] = [r.asDict() for r in rows.select(*columns).collect()]
        return len(held[os.path.basename(path)])

    summary = extract_source(spark, "anything", settings(tmp_path), ports=Ports(read=read, write=write))
    assert summary.written["masks"] == 1 and held["masks_list_generated.csv"][0]["mask"] == "port.com" and not (tmp_path / "out").exists()


def test_large_lists_are_directories(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i) for i in range(5)], "a string, __row long")
    assert csvio.write_list(rows, str(tmp_path / "one"), ["a"], dialect=cfg.Csv(largest_file=5)) == 5 and (tmp_path / "one").is_file()
    assert csvio.write_list(rows, str(tmp_path / "many"), ["a"], dialect=cfg.Csv(largest_file=4)) == 5 and (tmp_path / "many").is_dir()


def test_single_properties_override(tmp_path):
    over = cfg.from_environment({"TAMIS_LOOKUP__DEDUPLICATE": "false", "TAMIS_CHARSET": "utf-8", "HOME": "x"})
    config = cfg.merged(cfg.load(overrides=over), cfg.properties([("ioc.ingestion.max-files-per-poll", "7"), ("csv.delimiter", ",")]))
    assert (config.lookup.deduplicate, config.charset, config.ingestion.max_files_per_poll, config.csv.delimiter) == (False, "utf-8", 7, ",")
    with pytest.raises(cfg.ConfigError):
        cfg.load(overrides=cfg.properties([("csv.nothing", "1")]))


def test_merge_policies_are_a_registry(spark, monkeypatch):
    monkeypatch.setitem(registry.MERGE_POLICIES, "keep-last", lambda rows: first_by("neg")(rows.withColumn("neg", -F.col("ordinal"))).drop("neg"))
    rows = spark.createDataFrame([("a", "x", None, "s", 0), ("a", "y", None, "s", 1)], "mask string, note string, detected_at timestamp, source_key string, ordinal long")
    old = spark.createDataFrame([], "mask string, note string, __row long")
    merge = cfg.Merge("masks", ("mask",), conflict_policy="keep-last")
    out = aggregate({"masks": old}, {"masks": rows}, spark.createDataFrame([], INDEX_SCHEMA), [merge])
    assert [(r["mask"], r["note"]) for r in out.artifacts["masks"].collect()] == [("a", "y")]
