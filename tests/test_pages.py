import random
import re
from html import unescape

from pyspark.sql import functions as F

from quarterdeck.functions import html as H
from quarterdeck.functions import quarters as Q
from quarterdeck.operators import pages as P
from tests.page_parser import read_page

ID = '<div id="article-body-transcript">%s</div>'

# (html, text by the element tree)
TREE_CASES = [
    (ID % "<p> a <b> x </b> c </p><h2>T</h2><li>no</li><h3>&amp; z</h3>", "axc\n\nT\n\n& z"),
    (ID % "<p>a<p>b</p>c", "abc\n\nb"),                                   # an unclosed block holds the next
    (ID % "<p>a<br>b<img src=x>c</p>", "abc"),
    (ID % "<p>a<script>var x='<p>no</p>';</script>b</p><style>p{}</style>", "ab"),
    (ID % "<aside><p>no</p></aside><figure><h2>no</h2></figure><p>yes</p>", "yes"),
    (ID % "<p>a<!-- c -->b</p>", "ab"),
    (ID % "<p> \n </p>", None),
    ('<p>out</p><div class="x article-body-2 y"><p>in</p></div><p>out</p>', "in"),
    ('<div class="article-body"><p>class</p></div>' + ID % "<p>id</p>", "id"),
    ("<div><p>none</p></div>", None),
    (ID % "<p>a</i></b>c</p>", "ac"),                                     # closing tags of nothing
    (ID % "<P>Big</P>", "Big"),
    ('<div id="article-body-transcript"></div><div class="article-body"><p>x</p></div>', None),
]


def test_tree(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(TREE_CASES)], "i int, html string")
    ours = {r.i: r.text for r in P.page_texts(rows).collect()}
    assert [ours[i] for i in range(len(TREE_CASES))] == [t for _, t in TREE_CASES]


def tree_model(html):
    """A whole tree first, then its text: slower and written apart from the reader."""
    root = {"tag": "", "attrs": "", "nodes": [], "up": None}
    at = root
    for token in re.findall(r"<!--.*?-->|</?\w+[^>]*>|[^<]+", html, re.S):
        name = re.match(r"<(/?)(\w+)([^>]*)>", token)
        if token.startswith("<!--"):
            at["nodes"].append(None)
        elif not name:
            at["nodes"].append(unescape(token))
        elif name[1]:
            up = at
            while up is not None and up["tag"] != name[2]:
                up = up["up"]
            at = up["up"] if up is not None and up is not root else at
            at["nodes"].append(None)
        else:
            node = {"tag": name[2], "attrs": name[3], "nodes": [], "up": at}
            at["nodes"].append(node)
            at = at if name[2] in ("br", "img") else node

    def walk(node):
        for child in node["nodes"]:
            if isinstance(child, dict):
                yield child
                yield from walk(child)

    def strings(node):
        run = ""
        for child in [*node["nodes"], None]:
            if isinstance(child, str):
                run += child
                continue
            yield run
            run = ""
            if isinstance(child, dict) and child["tag"] not in ("script", "style", "aside", "figure", "img"):
                yield from strings(child)

    def outside(node):
        return node is None or node["tag"] not in ("script", "style", "aside", "figure") and outside(node["up"])

    nodes = list(walk(root))
    body = next((n for n in nodes if 'id="article-body-transcript"' in n["attrs"]), None) or next(
        (n for n in nodes if re.search('class="[^"]*article-body', n["attrs"])), None)
    if body is None:
        return None
    texts = ["".join(s.strip() for s in strings(n)) for n in walk(body) if n["tag"] in ("p", "h2", "h3") and outside(n["up"])]
    return "\n\n".join(t for t in texts if t) or None


def test_pages_against_parser_and_whole_tree(spark):
    """Random markup, unclosed, crossed and broken, read by expressions, by a parser and by way of a tree."""
    rng = random.Random(13)
    plain = ["<p>", "</p>", "<b>", "</b>", "<br>", "<h2>", "</h2>", "<aside>", "</aside>", "<figure>", "</figure>", "<div>",
             "</div>", " a ", "b", "&amp;", "<!-- c -->", "\n", "</h3>", "<h3>", "<img src='x'>", "</i>", "<i>"]
    odd = ["<script>x<p>y</script>", "<style>p{}</style>", "&eacute;", "&#233;", "&#x1F600;", "&#0;", " < ", "<p/>", "</article>", "&copy", "&copyx",
           "&nope;", "&", '<P class="a>b">', "\xa0x ", "<template>", "</template>", "<?pi x>", "<!X>"]
    cases = []
    for k in range(3000):
        inner = "".join(rng.choice(plain + odd * (k % 2)) for _ in range(rng.randint(0, 25)))
        mark = rng.choice(['id="article-body-transcript"', 'class="x article-body y"', "", "id='article-body-transcript'"][: 4 if k % 2 else 3])
        cases.append(f"<body><p>out</p><article {mark}>{inner}</article><p>out</p></body>")
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, html string").repartition(4)
    ours = {r.i: r.p for r in rows.select("i", H.page_parts(F.col("html")).alias("p")).collect()}
    for k, html in enumerate(cases):
        assert (ours[k].text, ours[k].visible) == read_page(html), html
        assert k % 2 or ours[k].text == tree_model(html), html


def test_pages_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "text only"), (4, "<p")], "i int, html string")
    assert [tuple(r) for r in P.page_texts(rows).orderBy("i").select("i", "text", "date_text").collect()] == [(k, None, "") for k in (1, 2, 3, 4)]


def test_call_date(spark):
    cases = [
        ("<p>DATE Wednesday, July 23, 2025 at 4:30</p>", "2025-07-23"),
        ("<p>Date: Friday  february 3 2024</p>", "2024-02-03"),
        ("<p>DATE: Monday, February 30, 2024</p>", None),
        ("<p>DATE: Monday, Brumaire 3, 2024</p>", None),
        ("<script>DATE Monday, July 1, 2025</script><p>none</p>", None),
        ("<p>DATE Monday, <b>July 1</b>, 2025</p>", "2025-07-01"),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    dated = P.page_texts(rows).select("i", Q.call_date(F.col("date_text")).cast("string").alias("d"))
    ours = {r.i: r.d for r in dated.collect()}
    assert [ours[i] for i in range(len(cases))] == [d for _, d in cases]


def test_pick_page(spark):
    hits = spark.createDataFrame([
        ("A", 2024, 1, 1, 1, "https://other.com/q1-2024", "t"),
        ("A", 2024, 1, 1, 2, "https://www.FOOL.com/a", "Results Q1 2024"),
        ("A", 2024, 1, 1, 3, "https://www.fool.com/b-q1-2024", None),
        ("A", 2024, 1, 2, 1, "https://www.fool.com/c-q1-2024", "x"),
        ("B", 2024, 2, 1, 9, "https://www.fool.com/q2-2024", "x"),
        ("B", 2024, 2, 2, 8, "https://www.fool.com/q2-2024-second-b", None),
        ("C", 2024, 2, 1, 1, "https://www.fool.com/q1-2024", "x"),
    ], "ticker string, year int, q int, query_no int, rank int, href string, title string")
    picked = {r.ticker: (r.url, r.entity_match) for r in P.pick_page(hits, entity_match=True).collect()}
    assert picked == {
        "A": ("https://www.FOOL.com/a", True), "B": ("https://www.fool.com/q2-2024-second-b", True),
    }


def test_gate_gives_the_first_reason(spark):
    rows = spark.createDataFrame([
        (1, None, None, None), (2, "u", None, None), (3, "u", "", "x" * 600), (4, "u", "h", "x" * 499),
        (5, "u", "h", "x" * 500), (6, "u", "h", None),
    ], "i int, url string, html string, text string")
    ours = [r.reject_reason for r in P.quality_gate(rows).orderBy("i").collect()]
    assert ours == ["no transcript found", "fetch failed", "fetch failed", "extraction failed", None, "extraction failed"]


def test_read_page_of_bytes(spark):
    from quarterdeck.sources.tables import read_pages
    rows = spark.createDataFrame([("a", bytearray("é<p>".encode())), ("b", None), ("c", bytearray(b"x\xff\xe9y"))], "url string, html binary")
    assert [(r.url, r.html) for r in read_pages(rows).collect()] == [("a", "é<p>"), ("c", "xy")]


def test_unclosed_markup_does_not_stop(spark):
    rows = spark.createDataFrame([("<div id='article-body-transcript'><p>a <b",)], "html string")
    assert P.page_texts(rows).first().text == "a"
