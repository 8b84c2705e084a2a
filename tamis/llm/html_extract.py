"""Main text of web pages, with removal of what a site's template repeats.

A page is parsed into a tree. Subtrees are hashed bottom-up; Spark counts on how
many pages of a host each occurs, inside a marked article as well as outside,
and those that recur on many are deleted wherever they stand. Pages with the
same content (the text of the article, or of the page if it marks none) count
once, so copies of an article on a host do not erase it. Elements that by tag or
class are menus, adverts, comments and the like go in any case. Only where a host
has too few contents for a count do the marked articles stand for the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, join_hot, materialise

#: A subtree belongs to the template if it is on this many pages of a host, and on this share of them (pages of the same content are one).
LEAST_PAGES, SHARE = 5, 0.2
#: The same share inside an article, where a passage that some articles quote is not template.
INSIDE_SHARE = 0.5
#: Host and hash pairs up to which the template is broadcast, after a count; beyond, it is joined.
BROADCAST_ROWS = 200_000
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "caption", "html", "tbody", "tfoot", "thead", "tr"}
KEEPS_P = ("table", "td", "th", "button", "object", "caption")
UNWANTED = frozenset("head nav footer aside form button select dialog menu object canvas audio video map".split())
OUTSIDE_ONLY, MARKED = frozenset({"header"}), frozenset({"article", "main"})
UNWANTED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist reply replies respond discussion disqus related recommended recommendations share sharing social toolbar pagination pager copyright skip skiplink".split()
)
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}

START, SPECIAL = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*)(>?))"), re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z0-9]+")


#: Digests of a host's template, each with whether it is meant inside an article.
Template = frozenset[tuple[int, bool]] | set[tuple[int, bool]]


class Element:
    __slots__ = ("tag", "attributes", "children", "digest", "unwanted", "running")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.digest = 0
        self.running = False  # part of running text, which is deleted as a whole or not at all
        self.unwanted = tag in UNWANTED or bool(attributes) and self._named()

    def _named(self) -> bool:
        if self.tag in {"html", "body", "article", "main"}:
            return False
        for m in ATTRIBUTE.finditer(self.attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return True
            if key in {"class", "id", "role"} and not UNWANTED_NAMES.isdisjoint(NAME.findall(value)):
                return True
        return False


class Tags:
    """Ends of tags, found in time that grows with the source, however broken it is."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">")
        self.dead: set[int] = set()  # quotes from which no end was found

    def end(self, at: int) -> int:
        """Place after the bracket that ends the tag whose attributes begin at ``at``, or -1; quotes hide brackets, a quote that never closes does not."""
        source, tried = self.source, []
        while at <= self.last:
            k = SPECIAL.search(source, at).start()
            if source[k] == ">":
                return k + 1
            if k in self.dead:
                break
            tried.append(k)
            close = source.find(source[k], k + 1)
            at = (k if close < 0 else close) + 1
        self.dead.update(tried)
        return -1


class Path:
    """The open elements, with the places of each tag."""

    def __init__(self, root: Element) -> None:
        self.open, self.places = [root], defaultdict(list)

    def push(self, e: Element) -> None:
        self.places[e.tag].append(len(self.open))
        self.open.append(e)

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def parse(source: str) -> Element:
    """A forgiving tree: what is open at the end is closed, stray end tags are ignored, a tag without an end is text."""
    root = Element("#root")
    path, tags = Path(root), Tags(source)
    begin = at = 0  # of the text that is not in the tree yet, and of the search

    def text(end: int) -> None:
        if end > begin:
            path.open[-1].children.append(entities.unescape(source[begin:end]))

    while m := START.search(source, at):
        comment, mark, slash, name, ended = m.groups()
        if comment or mark:
            end = source.find("-->", m.end()) if comment else source.find(">", m.end())
            end = len(source) if end < 0 else end + (3 if comment else 1)
        elif (end := m.end() if ended else tags.end(m.end())) < 0:
            at = m.start() + 1
            continue
        text(m.start())
        begin = at = end
        if comment or mark:
            continue
        tag = name.lower()
        if slash:
            if path.places[tag]:
                path.close(path.places[tag][-1])
            continue
        if tag in CLOSES_P and path.places["p"] and (place := path.places["p"][-1]) > path.innermost(KEEPS_P):
            path.close(place)
        if tag in SIBLINGS:
            own, within = SIBLINGS[tag]
            while (place := path.innermost(own)) > path.innermost(within):
                path.close(place)
        attributes = "" if ended else source[m.end() : end - 1]
        element = Element(tag, attributes.rstrip("/").strip())
        path.open[-1].children.append(element)
        if tag in RAW:
            stop = _raw_end(tag).search(source, at, tags.last + 1)
            element.unwanted = True
            element.children.append(source[at : stop.start() if stop else len(source)])
            begin = at = stop.end() if stop else len(source)
        elif tag not in VOID and (not attributes.endswith("/") or tag in BLOCK):  # a slash closes void and inline elements only
            path.push(element)
    text(len(source))
    _hash(root)
    return root


def _hash(root: Element) -> None:
    """Digest of each subtree from tag, attributes and children, and whether it is part of running text, without recursion."""
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        e, done = stack.pop()
        if not done:
            stack.append((e, True))
            text = e.running or any(isinstance(c, str) and not c.isspace() for c in e.children)
            for c in e.children:
                if isinstance(c, Element):
                    c.running = text and c.tag not in BLOCK
                    stack.append((c, False))
            continue
        h = xxhash.xxh64(f"{e.tag} {e.attributes}\0")
        for c in e.children:
            h.update(c.digest.to_bytes(8, "little") if isinstance(c, Element) else (" ".join(c.split()) + "\0").encode("utf-8", "replace"))
        e.digest = h.intdigest()


def _main(root: Element) -> list[Element]:
    """What a page marks as its main text: the outermost main elements, else the outermost articles, in page order."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    stack = [(root, "")]
    while stack:
        e, within = stack.pop()
        if e.tag in found and within != e.tag:
            found[e.tag].append(e)
            within = e.tag
        if not e.unwanted:
            stack.extend((c, within) for c in reversed(e.children) if isinstance(c, Element))
    return found["main"] or found["article"]


def marked_text(root: Element) -> str:
    """Text of what is marked, without regard to templates; empty if nothing is."""
    return "\n".join(line for e in _main(root) for line in blocks(e))


def subtrees(root: Element) -> set[tuple[int, bool]]:
    """(digest, in an article) of the subtrees that can be template: those in unwanted elements go anyway."""
    out, stack = set(), [(root, False)]
    while stack:
        e, inside = stack.pop()
        for c in e.children:
            if isinstance(c, Element) and not c.unwanted and (c.children or c.tag not in VOID):
                if not c.running:
                    out.add((c.digest, inside))
                stack.append((c, inside or c.tag == "article"))
    return out


def content_of(root: Element) -> int:
    """Hash of the text of what is marked, or of the whole page if that is empty."""
    return xxhash.xxh64((marked_text(root) or "\n".join(blocks(root))).encode("utf-8", "replace")).intdigest()


def blocks(top: Element, template: Template = frozenset()) -> list[str]:
    """Texts of the blocks below ``top`` in page order; subtrees of the template, unwanted elements and headers outside an article are left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        words = "".join(held).split()
        held.clear()
        if words:
            out.append(" ".join(words))

    stack: list[Element | str | None] = list(reversed(top.children))
    # By open marked element, what is left on the stack when it ends; and whether it or one around it is an article.
    within = [(-1, top.tag == "article")] if top.tag in MARKED else []
    while stack:
        node = stack.pop()
        while within and len(stack) < within[-1][0]:
            within.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            held.append(node)
        elif node.unwanted or not node.running and (node.digest, bool(within) and within[-1][1]) in template or node.tag in OUTSIDE_ONLY and not within:
            if node.tag in BLOCK:
                flush()
        else:
            if node.tag in BLOCK:
                flush()
                stack.append(None)
                if node.tag in MARKED:
                    within.append((len(stack), node.tag == "article" or bool(within) and within[-1][1]))
            elif node.tag in {"br", "td", "th"}:
                held.append(" ")
            stack.extend(reversed(node.children))
    flush()
    return out


def extract(source: str | None, template: Template | None = None) -> str:
    """The main text of a page: its blocks without the template of its host, joined by line feeds.

    Without a template (the host has too few contents to count) what is marked as main text stands for it.
    """
    root = parse(source or "")
    return (template is None and marked_text(root)) or "\n".join(blocks(root, template or frozenset()))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; a null or odd one counts as the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template_of(pages: DataFrame) -> DataFrame:
    """(host, digest, inside, pages): the subtrees that recur on many pages of a host; a null digest counts all its pages.

    Pages of the same content are one. The distinct count is made in two exchanges, the first by content too, so a large host is no heavy key.
    """
    bounded_batches(pages.sparkSession, 128)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int | None, bool, int], None] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root = parse(source.as_py())
                content = content_of(root) - (1 << 63)
                seen[host, None, False, content] = None
                seen.update(((host, digest - (1 << 63), inside, content), None) for digest, inside in subtrees(root))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
            columns = zip(*seen, strict=True) if seen else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "digest", "inside", "content"])

    counts = rows.mapInArrow(count, "host string, digest long, inside boolean, content long").groupBy("host", "digest", "inside").agg(F.count_distinct("content").alias("pages"))
    return counts.where(F.col("pages") >= LEAST_PAGES)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Defined cases: null html gives the empty text; null urls share the empty host;
    repeated rows a row each; an empty table gives an empty result; other columns are ignored.
    """
    counts = materialise(template_of(pages))
    totals = counts.where("digest is null").select("host", F.col("pages").alias("total"))
    share = F.when(F.col("inside"), INSIDE_SHARE).otherwise(SHARE)
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    many = counts.where("digest is not null").join(totals, "host").where(F.col("pages") >= share * F.col("total"))
    known = many.select("host", "digest", "inside").unionByName(totals.select("host", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("boolean").alias("inside")))  # a host without template has an empty list
    entry = F.when(F.col("digest").isNotNull(), F.struct("digest", "inside"))
    template = known.groupBy("host").agg(F.collect_list(entry).alias("digests"))  # at most 1 / SHARE times the subtrees of a page
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    # A large host's pages stay where they are, its template goes to them.
    joined = rows.join(F.broadcast(template), "host", "left") if small else join_hot(rows, materialise(template), "host", rows.count(), "left")
    joined = joined.select("page_id", "url", "html", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple | None, Template | None] = {}
        for b in batches:
            texts = []
            for source, digests in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                key = None if digests is None else tuple((d["digest"], d["inside"]) for d in digests)
                if key not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[key] = None if key is None else frozenset((d + (1 << 63), inside) for d, inside in key)
                texts.append(extract(source.as_py(), sets[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
