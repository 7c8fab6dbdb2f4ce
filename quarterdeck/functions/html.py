"""Body text and visible text of a page, as expressions over the stream of its tags.

A page is cut into tags, comments and texts by one pattern. A fold over the tags keeps the open elements as a stack: an end
tag closes the nearest open element of its name and all that opened after it, and is ignored where there is none; nothing
else closes an element, so an unclosed block holds the blocks that follow it. Only elements that matter leave the fold, as
spans of token numbers: the marked ones, blocks, and those whose text does not count. A block's text is then a slice of the
page's texts. All of it runs in the JVM, row by row: nothing is shuffled and no element is a row.
"""

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X

# --- element names (fixed values) ------------------------------------------
BLOCKS = ("p", "h2", "h3")
REMOVED = ("aside", "figure")
NOT_TEXT = ("template", "rt", "rp")
#: Elements that HTML, now or formerly, defines to have no content.
CHILDLESS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
    "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
)

#: Scripts and styles are one token with their content, which is no markup.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\z)|<[!?/][^>]*+(?:>|\z)"
    r"|<[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-z][^>]*+(?:>|\z)|(?:[^<]++|<(?![a-z/!?]))++"
)
TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
MARKED_ID = rf"\s(?i:id)\s*=\s*(?:\"{V.TRANSCRIPT_ID}\"|'{V.TRANSCRIPT_ID}'|{V.TRANSCRIPT_ID}(?:[\s/>]|$))"
MARKED_CLASS = rf"\s(?i:class)\s*=\s*(?:\"[^\"]*{V.TRANSCRIPT_CLASS}|'[^']*{V.TRANSCRIPT_CLASS}|[^\s\"'>]*{V.TRANSCRIPT_CLASS})"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"
#: Characters by name, with the semicolon and, where HTML allows it, without; the names of HTML 4.
NAMED = {name: char for name, char in html5.items() if name.rstrip(";") in name2codepoint}
#: Of a longer run of letters, the longest name at its beginning that may stand without a semicolon.
NAMED_PART = "^&(" + "|".join(sorted((name for name in NAMED if name[-1] != ";"), key=lambda n: (-len(n), n))) + ")"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decoded(text: Column) -> Column:
    """Text with its character references replaced; unknown names stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def char(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#([0-9]+)", 1)
        code = F.when(digits != "", digits.cast("long")).otherwise(
            F.conv(F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long")
        )
        no_char = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(no_char, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        short = F.regexp_extract(part, NAMED_PART, 1)
        begun = F.when(short != "", F.concat(F.try_element_at(names, short), F.substr(part, F.length(short) + 2)))
        named = F.coalesce(F.try_element_at(names, F.substr(part, F.lit(2))), begun, part)
        return F.when(part.rlike("^&#"), number).when(part.rlike("^&[A-Za-z]"), named).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, char), "")).otherwise(text)


def _tokens(html: Column) -> Column:
    """(at, kind, name, mark, text): kind is text, open, close, alone (no content) or other; mark 1 by id, 2 by class; text has its
    references replaced."""

    def token(raw: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, TAG_NAME, 1))
        is_tag = raw.rlike(r"^</?[A-Za-z]") & ~name.isin("script", "style")
        kind = (
            F.when(~raw.rlike(r"^<[A-Za-z/!?]"), "text").when(~is_tag, "other").when(F.startswith(raw, F.lit("</")), "close")
            .when(name.isin(*CHILDLESS) | F.endswith(raw, F.lit("/>")), "alone").otherwise("open")
        )
        mark = F.when(F.startswith(raw, F.lit("</")), 0).when(raw.rlike(MARKED_ID), 1).when(raw.rlike(MARKED_CLASS), 2).otherwise(0)
        return F.struct(at.alias("at"), kind.alias("kind"), name.alias("name"), mark.alias("mark"), F.when(kind == "text", decoded(raw)).alias("text"))

    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), token)


OPEN = "array<struct<name:string,at:int,mark:int>>"
SPANS = "array<struct<name:string,at:int,mark:int,end:int>>"


def _spans(tokens: Column) -> Column:
    """The elements that matter, from the token that opens them to the one that closes them."""

    def matters(e: Column) -> Column:
        return (e["mark"] > 0) | e["name"].isin(*BLOCKS, *REMOVED, *NOT_TEXT)

    def closed(elements: Column, end: Column) -> Column:
        return F.transform(F.filter(elements, matters), lambda e: F.struct(e["name"].alias("name"), e["at"].alias("at"), e["mark"].alias("mark"), end.alias("end")))

    def state(stack: Column, spans: Column) -> Column:
        return F.struct(stack.alias("stack"), spans.alias("spans"))

    def step(acc: Column, tag: Column) -> Column:
        stack, spans = acc["stack"], acc["spans"]
        element = F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("at"), tag["mark"].alias("mark")))
        above = F.array_position(F.reverse(F.transform(stack, lambda e: e["name"])), tag["name"]).cast("int")
        return (
            F.when(tag["kind"] == "open", state(F.concat(stack, element), spans))
            .when(tag["kind"] == "alone", state(stack, F.concat(spans, closed(element, tag["at"]))))
            .when(above > 0, state(
                F.slice(stack, F.lit(1), F.size(stack) - above), F.concat(spans, closed(F.slice(stack, F.size(stack) - above + 1, above), tag["at"]))
            )).otherwise(acc)
        )

    tags = F.filter(tokens, lambda t: t["kind"].isin("open", "close", "alone"))
    start = state(F.array().cast(OPEN), F.array().cast(SPANS))
    return F.aggregate(tags, start, step, lambda acc: F.concat(acc["spans"], closed(acc["stack"], F.size(tokens))))


def _inside(at: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["at"] < at) & (at < s["end"]))


def _body_text(tokens: Column, spans: Column) -> Column:
    def first(mark: int) -> Column:
        return F.array_min(F.transform(F.filter(spans, lambda s: s["mark"] == mark), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))))

    def within(body: Column) -> Column:
        inner = F.filter(spans, lambda s: (s["at"] > body["at"]) & (s["at"] < body["end"]))
        return _let(F.filter(inner, lambda s: s["name"].isin(*REMOVED)), lambda removed: _let(
            F.filter(spans, lambda s: s["name"].isin(*NOT_TEXT)), lambda hidden: _let(
                F.transform(tokens, lambda t: F.when((t["kind"] == "text") & ~_inside(t["at"], removed) & ~_inside(t["at"], hidden), X.strip(t["text"]))),
                lambda texts: joined(F.array_sort(F.transform(
                    F.filter(inner, lambda s: s["name"].isin(*BLOCKS) & ~_inside(s["at"], removed)), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))
                )), texts),
            ),
        ))

    def joined(blocks: Column, texts: Column) -> Column:
        each = F.transform(blocks, lambda b: F.array_join(F.slice(texts, b["at"] + 2, F.greatest(b["end"] - b["at"] - 1, F.lit(0))), ""))
        return F.nullif(F.array_join(F.filter(each, lambda t: t != ""), "\n\n"), F.lit(""))

    return _let(F.coalesce(first(1), first(2)), lambda body: F.when(body.isNotNull(), within(body)))


def _visible_text(tokens: Column, spans: Column) -> Column:
    return _let(F.filter(spans, lambda s: s["name"].isin(*NOT_TEXT)), lambda hidden: F.array_join(
        F.transform(F.filter(tokens, lambda t: (t["kind"] == "text") & ~_inside(t["at"], hidden)), lambda t: t["text"]), ""))


def body_text(html: Column) -> Column:
    """Text of the transcript's body: each paragraph and heading in it, without asides and figures; null if there is none.

    The body is the first element marked by id, else the first marked by class. A block has the texts of the blocks in
    it as well; each text is stripped before texts are joined."""
    return _let(_tokens(html), lambda tokens: _let(_spans(tokens), lambda spans: _body_text(tokens, spans)))


def visible_text(html: Column) -> Column:
    """All text of a page but that of scripts, styles, templates and comments."""
    return _let(_tokens(html), lambda tokens: _visible_text(tokens, _spans(tokens)))


def page_parts(html: Column) -> Column:
    """(text, visible) of a page, from one pass over its tags; of a null page, nulls."""
    return _let(_tokens(html), lambda tokens: _let(_spans(tokens), lambda spans: F.struct(
        _body_text(tokens, spans).alias("text"), _visible_text(tokens, spans).alias("visible"))))
