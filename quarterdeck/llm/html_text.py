"""Main text of web pages by removal of each site's template.

Every page becomes a tree of elements. The hash of an element covers its whole subtree: tags, classes and text, not the
addresses it links to. Spark counts on how many different pages of a host each subtree stands, pages with the same text
being one; those on enough are the site's template and are deleted from its pages. What a page says by its markup counts
as well: navigation, headers, footers, asides, forms, scripts, adverts, notices and comments go by tag, role or name, and
where there is an article or main element with text, only that is read. Inside it, paragraphs and headings are the
author's even if they recur.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups, written

#: A subtree is template if it stands on so many pages of the host that differ in their texts, however large the host is.
LEAST_PAGES = 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph.
_ENDS_P = _BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "figcaption"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe svg canvas object menu dialog".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: A class or id names a part beside the text if all its words are of these two lists and one is of the first.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget widgets footer header masthead cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments commentlist reply replies respond disqus pagination pager toolbar skip".split()
)
_NEUTRAL = frozenset(
    "site main page top bottom left right primary secondary global container wrapper wrap box block bar list section area links link form inner outer "
    "content body item items group panel slot unit posts stories articles to us icons buttons button text".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Text blocks of an article are kept even where they recur, and no name drops them.
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption br hr".split())
_NEVER_NAMED = _TEXT_BLOCKS - {"li", "dd", "dt", "td", "th"} | {"html", "body", "main"}
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())


class Element:
    __slots__ = ("tag", "label", "dropped", "named", "items")

    def __init__(self, tag: str, label: str = "", dropped: bool = False, named: bool = False):
        self.tag, self.label, self.dropped, self.named = tag, label, dropped, named
        self.items: list = []  # elements and texts


@lru_cache(4096)
def names_part(name: str, parts: frozenset = _PARTS) -> bool:
    """Whether a class or id names one of the parts: sidebar-left and siteFooter do, no-sidebar and comments-on-policy don't."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    return any(w in parts for w in words) and all(w in parts or w in _NEUTRAL for w in words)


def _element(tag: str, attributes: str) -> Element:
    label, dropped, named = "", tag in _DROPPED, False
    if attributes:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        label = " ".join(values[k] for k in ("class", "id", "role") if values.get(k))
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true"
        dropped = dropped or hidden or values.get("role", "").lower() in _ROLES
        if tag not in _NEVER_NAMED:
            parts = _COMMENTS if tag == "article" else _PARTS
            named = any(names_part(n, parts) for k in ("class", "id") for n in values.get(k, "").split())
    return Element(tag, label, dropped, named)


def _settle(root: Element) -> None:
    """Decides what only the whole tree can tell: a named part goes unless the page's first-level heading or main element is
    in it; the header of an article stays if a heading is in it."""
    order: list[tuple[Element, bool]] = []
    todo = [(root, False)]
    while todo:
        element, inside = todo.pop()
        order.append((element, inside))
        inside = inside or element.tag in ("article", "main")
        todo += [(x, inside) for x in element.items if isinstance(x, Element)]
    holds: dict[int, int] = {}  # 1: a heading, 2: the first-level heading or main
    for element, inside in reversed(order):
        value = 3 if element.tag in ("h1", "main") else 1 if element.tag in ("h2", "h3") else 0
        for x in element.items:
            if isinstance(x, Element):
                value |= holds[id(x)]
        holds[id(element)] = value
        if element.named and not value & 2:
            element.dropped = True
        elif element.tag == "header" and inside and value:
            element.dropped = False


def parse(html: str) -> Element:
    """The page's tree. Unclosed paragraphs, items and cells end where the next begins; stray end tags are ignored."""
    root = Element("#page")
    stack, at = [root], 0
    while match := _TOKEN.match(html, at):
        at = match.end()
        tag = match[2]
        if tag is None:
            text = match[0]
            if not text.startswith(("<!", "<?")) or text == "<":
                stack[-1].items.append(text)
            continue
        tag = tag.lower()
        if match[1]:
            if any(e.tag == tag for e in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        element = _element(tag, match[3].rstrip("/"))
        stack[-1].items.append(element)
        if tag in _VOID or match[3].endswith("/") and tag == "svg":
            continue
        if tag in _RAW:  # its text is not markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            element.items.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            continue
        stack.append(element)
    _settle(root)
    return root


def subtree_hashes(root: Element) -> dict[int, list[Element]]:
    """The elements with text of a page by the 64-bit hashes of their subtrees."""
    found: dict[int, list[Element]] = {}
    # children before parents, without recursion: pages can be nested deeply
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [x for x in element.items if isinstance(x, Element)]
    made: dict[int, bytes] = {}
    texts: dict[int, bool] = {}
    for element in reversed(order):
        digest, worded = hashlib.blake2b(f"{element.tag}\x1f{element.label}\x1e".encode(), digest_size=8), False
        for x in element.items:
            if isinstance(x, Element):
                digest.update(b"\x01" + made[id(x)])
                worded |= texts[id(x)]
            elif text := " ".join(x.split()):
                digest.update(b"\x02" + text.encode("utf-8", "replace") + b"\x03")
                worded = True
        made[id(element)], texts[id(element)] = digest.digest(), worded
        if worded and element.tag[0] != "#":
            found.setdefault(int.from_bytes(made[id(element)], "little", signed=True), []).append(element)
    return found


def _worded(element: Element) -> bool:
    """Whether an element has text outside of what is dropped."""
    todo: list = [element]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif not x.dropped:
            todo += x.items
    return False


def _contents(root: Element) -> list[Element]:
    """The outermost article and main elements with text that are not dropped; the whole page if there are none."""
    found, todo = [], [root]
    while todo:
        element = todo.pop()
        if element.dropped:
            continue
        if element.tag in ("article", "main"):
            if _worded(element):
                found.append(element)
        else:
            todo += [x for x in reversed(element.items) if isinstance(x, Element)]
    return found or [root]


def deletable(root: Element, contents: list[Element]) -> dict[int, Element]:
    """The elements of the main text, by identity, that a template can delete: all but the text blocks inside an article."""
    found: dict[int, Element] = {}
    whole, todo = contents[0] is root, list(contents)
    while todo:
        element = todo.pop()
        if element.dropped or element.tag in ("title", "head"):
            continue
        if element is not root and element.tag not in ("html", "body", "article", "main"):
            if whole or element.tag not in _TEXT_BLOCKS and element.tag not in _INLINE:
                found[id(element)] = element
        todo += [x for x in element.items if isinstance(x, Element)]
    return found


def open_subtrees(root: Element, subtrees: dict[int, list[Element]]) -> list[int]:
    """The hashes of subtrees whose deletion changes the page's main text."""
    able = deletable(root, _contents(root))
    return [value for value, elements in subtrees.items() if any(id(e) in able for e in elements)] if able else []


def main_text(root: Element, template: set[int]) -> str:
    """Blocks of the main text of a parsed page, one a line; template: subtree hashes to delete."""
    contents = _contents(root)
    deleted: set[int] = set()
    if template:
        able = deletable(root, contents)
        deleted = {id(e) for value, elements in subtree_hashes(root).items() if value in template for e in elements if id(e) in able}
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    todo: list = list(reversed(contents))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped and id(x) not in deleted and x.tag not in ("title", "head"):
            if x.tag in _BLOCKS:
                close()
                todo.append(None)
            todo += reversed(x.items)
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARSED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("key", pa.int64()), ("site", pa.int64()), ("content", pa.int64()),
    ("subtrees", pa.list_(pa.int64())), ("open", pa.list_(pa.int64())), ("text", pa.string()), ("html", pa.string()),
])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page parsed once, as a written table: page_id, url, key (hash of host and html), site, text with nothing deleted yet,
    content (hash of that text), subtrees (hashes of all elements with text) and open (those whose deletion changes the text).

    Only pages with open subtrees keep their html; the text of the others is final.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                rows = []
                for html in batch.column(4).to_pylist():
                    root = parse(html or "")
                    text, subtrees = main_text(root, set()), subtree_hashes(root)
                    content = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                    able = open_subtrees(root, subtrees)
                    rows.append((content, list(subtrees), able, text, html if able else None))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_PARSED)[4:], strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:4] + columns, _PARSED)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    keyed = own.select("page_id", "url", F.xxhash64("host", "html").alias("key"), F.xxhash64("host").alias("site"), "html")
    shape = "page_id long, url string, key long, site long, content long, subtrees array<long>, open array<long>, text string, html string"
    return written(keyed.mapInArrow(read, shape))


def page_templates(parsed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """key, members, template: of each page with open subtrees that stand on least_pages different pages of its host, these
    subtrees and the number of rows that are this page; a written table.

    Pages are counted by (host, subtree) after repeated contents are gone, combined before the shuffle. What is template goes
    back to the pages that have it, subtree by subtree; one that stands on very many pages leaves their rows where they are.
    """
    value = F.xxhash64("site", "value").alias("id")
    every = parsed.select("site", "content", F.explode("subtrees").alias("value")).select(value, "content").distinct()
    counted = every.groupBy("id").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    pages = parsed.where(F.size("open") > 0).groupBy("key").agg(F.first("site").alias("site"), F.first("open").alias("open"), F.count("*").alias("copies"))
    able = written(pages.select("key", "site", "copies", F.explode("open").alias("value")).withColumn("id", F.xxhash64("site", "value")))
    templates = written(counted.join(able.groupBy("id").agg(F.count("*").alias("members")), "id").select("id", "members"))
    found = joined_on_groups(able, templates, "id")
    return written(found.groupBy("key").agg(F.first("copies").alias("members"), F.collect_list("value").alias("template")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: whole main text, blocks joined by line feeds, empty if there is none.

    Character references are decoded, white space within a block is one space. Null html is empty; pages without a host
    share one template. Only pages whose text a template could change meet theirs, by the hash of host and html; a page with
    very many copies leaves them where they are, no other page's html is shuffled, and no task reads a whole host.
    """
    parsed = parsed_pages(pages)
    final = parsed.where(F.size("open") == 0).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    left = parsed.where(F.size("open") > 0).select("key", "page_id", "url", "text", "html")
    met = joined_on_groups(left, page_templates(parsed), "key", "left").select("page_id", "url", "text", "html", "template")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(parse(html), set(template)) if template else text
                for text, html, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            ]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return final.unionByName(met.mapInArrow(read, "page_id long, url string, text string, n_chars long"))
