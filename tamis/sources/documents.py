"""Documents of any supported format as text.

Files are read by Spark's binary reader, so any store works and executors open
them; a Python worker turns one file at a time into text. A block of HTML, a
paragraph of a word document and a row of a sheet end in a line feed.
"""

from __future__ import annotations

import email
import email.policy
import html.parser
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead tr ul".split())
SILENT = frozenset({"script", "style", "head", "title", "noscript", "template"})
CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)


#: The parts of rich text, and the groups that hold none.
RTF = re.compile(r"(?P<brace>[{}])|\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<star>\*)|\\(?P<word>[a-z]+)(?P<number>-?\d+)?[ ]?|\\(?P<sign>[^a-z'*])|[\r\n]+|(?P<text>[^{}\\\r\n]+)")
RTF_SILENT = frozenset({"fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "datastore"})
#: A reader of a format: name in lower case and content to text, or null if it is not its format.
Reader = Callable[[str, bytes], str | None]


class UnsupportedFormat(ValueError):
    """A file that no reader here understands."""


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.out.append("\n")
        elif tag in {"td", "th"}:
            self.out.append("\t")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.out.append("\n")
        if tag == "head":
            self.silent = 0

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def decode(content: bytes, charset: str) -> str:
    """By byte-order mark, character set declared at the top (where pages must have it), UTF-8 if it is that, else ``charset``."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    if m := CHARSET.search(content[:4096]):
        try:
            return content.decode(m[1].decode("ascii"), "replace")
        except LookupError:
            pass
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode(charset, "replace")


def html_text(source: str) -> str:
    parser = _Text()
    parser.feed(source)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


def _xml_text(root: ElementTree.Element, line: str, cell: str | None = None) -> str:
    """Text of t elements; a line ends at each ``line`` element, a tab stands between ``cell`` elements."""
    lines = []
    for e in root.iter():
        if e.tag.rpartition("}")[2] == line:
            parts = []
            for x in e.iter():
                kind = x.tag.rpartition("}")[2]
                if kind == "t":
                    parts.append(x.text or "")
                elif kind in {"tab", "br"}:
                    parts.append("\t" if kind == "tab" else "\n")
                elif kind == cell and parts:
                    parts.append("\t")
            lines.append("".join(parts))
    return "\n".join(lines)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _xml_text(ElementTree.fromstring(z.read("word/document.xml")), "p")


def _members_text(content: bytes, pattern: str, line: str) -> str:
    """Text of the parts of an archive whose names match, in order of the number in the name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: (int("0" + re.sub(r"\D", "", n)), n))
        return "\n".join(_xml_text(ElementTree.fromstring(z.read(n)), line) for n in names)


def odt_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n".join("".join(e.itertext()) for e in root.iter() if e.tag.rpartition("}")[2] in {"p", "h"})


def rtf_text(source: str) -> str:
    """Text of a rich-text file: control words go, escaped characters are decoded, groups of tables and pictures are left out."""
    out: list[str] = []
    silent, skip, depth = 0, 0, 0  # depth at which a left-out group began; characters that stand for an escaped one
    codec = m[1] if (m := re.search(r"\\ansicpg(\d+)", source)) else "1252"
    for t in RTF.finditer(source):
        if t["brace"]:
            depth += 1 if t["brace"] == "{" else -1
            silent = 0 if depth < silent else silent
        elif t["star"] or t["word"] in RTF_SILENT:
            silent = silent or depth
        elif silent:
            continue
        elif t["hex"]:
            if skip:
                skip -= 1
            else:
                out.append(bytes.fromhex(t["hex"]).decode(f"cp{codec}", "replace"))
        elif t["word"] == "u" and t["number"]:
            out.append(chr(int(t["number"]) % 65536))
            skip = 1
        elif t["word"]:
            out.append({"par": "\n", "line": "\n", "row": "\n", "cell": "\t", "tab": "\t"}.get(t["word"], ""))
        elif t["sign"]:
            out.append({"~": " ", "_": "-"}.get(t["sign"], t["sign"] if t["sign"] in "\\{}" else ""))
        elif t["text"]:
            out.append(t["text"][skip:])
            skip = 0
    return "".join(out).strip()


def mail_text(content: bytes, charset: str) -> str:
    """Subject and body of a message: the plain parts, or the HTML where there are none, and readable attachments."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    parts = [message["subject"] or ""]
    body = message.get_body(("plain", "html"))
    if body is not None:
        parts.append(html_text(body.get_content()) if body.get_content_type() == "text/html" else body.get_content())
    for a in message.iter_attachments():
        held = a.get_content()
        raw = held if isinstance(held, bytes) else held.encode("utf-8") if isinstance(held, str) else held.as_bytes()
        try:
            parts.append(text_of(a.get_filename() or "", raw, charset))
        except UnsupportedFormat:
            continue
    return "\n".join(p.strip() for p in parts if p.strip())


def xlsx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.rpartition("}")[2] == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.rpartition("}")[2] == "si"]
        rows = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.rpartition("}")[2] == "row"):
                cells = []
                for c in row:
                    value = "".join(v.text or "" for v in c.iter() if v.tag.rpartition("}")[2] in {"v", "t"})
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                rows.append("\t".join(cells))
        return "\n".join(rows)


def text_of(path: str, content: bytes, charset: str = "windows-1251", readers: Iterable[Reader] = ()) -> str:
    """Text of one file, by its content and, for the rest, its name; ``readers`` are asked first, and null means not theirs."""
    name = path.rsplit("/", 1)[-1].lower()
    for reader in readers:
        if (own := reader(name, content)) is not None:
            return own
    if content.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
        if "word/document.xml" in names:
            return docx_text(content)
        if "xl/workbook.xml" in names:
            return xlsx_text(content)
        if "ppt/presentation.xml" in names:
            return _members_text(content, r"ppt/slides/slide\d+\.xml", "p")
        if {"mimetype", "content.xml"} <= names:
            return odt_text(content)
        raise UnsupportedFormat(f"{path}: an archive that is no document, workbook or presentation")
    if content.startswith(b"%PDF-"):
        raise UnsupportedFormat(f"{path}: PDF needs a library that is not there")
    if name.endswith(".eml"):
        return mail_text(content, charset)
    if content.startswith(b"{\\rtf"):
        return rtf_text(content.decode("latin-1"))
    text = decode(content, charset)
    if name.endswith((".htm", ".html", ".xhtml")) or re.match(r"\s*(?:<!doctype html|<html|<\?xml[^>]*>\s*<html)", text, re.I):
        return html_text(text)
    return text


def read_documents(spark: SparkSession, path: str | list[str], charset: str = "windows-1251", readers: Iterable[Reader] = (), **options: object) -> DataFrame:
    """(doc_id, path, source_key, modified, text, error): one row a file.

    doc_id is the path. A file that can't be read has a null text and the reason in ``error``. ``readers`` add
    formats (PDF, for one, where the executors have a library): functions of name and content, sent to the executors.
    """
    return texts(spark.read.format("binaryFile").options(**options).load(path), charset, readers)


def texts(files: DataFrame, charset: str = "windows-1251", readers: Iterable[Reader] = ()) -> DataFrame:
    """The same from rows of the binary reader, streamed or not."""
    readers = tuple(readers)
    rows = files.select("path", F.lower(F.sha2("content", 256)).alias("source_key"), F.col("modificationTime").alias("modified"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, wrong = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                try:
                    found.append(text_of(path, content.as_py(), charset, readers))
                    wrong.append(None)
                except Exception as e:  # noqa: BLE001 - the reason is reported in the row
                    found.append(None)
                    wrong.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(1), b.column(2), pa.array(found, pa.string()), pa.array(wrong, pa.string())], ["doc_id", "path", "source_key", "modified", "text", "error"])

    return rows.mapInArrow(run, "doc_id string, path string, source_key string, modified timestamp, text string, error string")
