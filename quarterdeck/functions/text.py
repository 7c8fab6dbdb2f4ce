"""Text and number columns: stripping, sections, speakers, figures, chunks.

Java options used with the patterns: ``d`` makes a dot stop at newline only,
``U`` gives Unicode classes, ``i`` ignores case.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V

WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
PLAIN = "(?dU)"
ANY_CASE = "(?idU)"
ANY_CASE_ASCII = "(?id)"
# letters outside ASCII that equal an ASCII letter when case is ignored (fixed values)
FOLDING_LETTERS = ["ſ", "ı", "İ", "K"]


def strip(text: Column) -> Column:
    """Cut white space of every kind at both ends; ``trim`` alone cuts blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def rest_from(text: Column, pattern: str, options: str = PLAIN) -> Column:
    """From the leftmost match to the end of the text; empty without a match."""
    return F.regexp_extract(text, f"{options}(?:{pattern})(?s:.*)", 0)


def _has_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def split_sections(text: Column, questions_start: str, needs: list[str]) -> Column:
    """Struct of remarks and questions, cut at the leftmost questions marker.

    The cut is found as the length of what remains, so it counts characters and
    does not drift after characters outside the basic plane. ``needs`` are
    capitals of which every marker has one: texts without them are not searched.
    Case is ignored the quick way unless a text has one of the few letters for
    which that makes a difference.
    """
    slow, quick = rest_from(text, questions_start, ANY_CASE), rest_from(text, questions_start, ANY_CASE_ASCII)
    rest = F.when(~_has_any(F.upper(text), needs), F.lit("")).when(_has_any(text, FOLDING_LETTERS), slow).otherwise(quick)

    def cut(rest: Column) -> Column:
        remarks = strip(F.substring(text, F.lit(1), F.length(text) - F.length(rest)))
        return F.struct(
            F.when(rest == "", text).otherwise(remarks).alias("prepared_remarks"),
            strip(rest).alias("questions_and_answers"),
        )

    # a list of one, so that the search is written and done once
    return F.get(F.transform(F.array(rest), cut), F.lit(0))


def page_sections(text: Column) -> Column:
    return split_sections(text, V.PAGE_QUESTIONS_START, V.QUESTIONS_NEED)


def call_sections(text: Column) -> Column:
    return split_sections(text, V.CALL_QUESTIONS_START, V.QUESTIONS_NEED)


def _names(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PLAIN + pattern), F.lit(1))


def _short(names: Column) -> Column:
    return F.filter(names, lambda n: F.length(n) < V.MAX_NAME_LENGTH)


def distinct_sorted(*name_lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*name_lists)))


def page_speakers(text: Column) -> Column:
    """Names of the participants block and of ``Name -- word`` anywhere, sorted."""
    block = F.regexp_extract(text, ANY_CASE + V.PARTICIPANTS_BLOCK, 1)
    return distinct_sorted(
        _names(block, V.NAME_AFTER_DASH),
        _names(block, V.NAME_BEFORE_DASH),
        _short(_names(text, V.NAME_DASH_WORD)),
    )


def call_speakers(text: Column) -> Column:
    """Names handed over to, thanked, or introduced with a title early on, sorted."""
    thanked = F.transform(_names(text, V.THANKED), strip)
    return distinct_sorted(
        _short(_names(text, V.HANDED_OVER_TO)),
        _short(F.filter(thanked, lambda n: F.contains(n, F.lit(" ")))),
        _short(_names(clip(text, V.INTRO_LENGTH), V.NAME_AND_TITLE)),
    )


def float_text(number: Column) -> Column:
    """A double as the shortest text with a decimal point: 5.0, 12345678.0, 1e+16."""
    number = number.try_cast("double")
    size = F.abs(number)
    plain = F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    parts = F.split(number.cast("string"), "E")
    power = F.get(parts, F.lit(1)).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(
            F.abs(power).cast("string")
        ),
    )
    return (
        F.when(size == 0, F.lit("0.0"))
        .when(size == F.lit(float("inf")), F.when(number < 0, "-inf").otherwise("inf"))
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def key_numbers(text: Column) -> Column:
    """Map of the first revenue figure and the first early EPS figure; absent keys left out.

    The long text is searched once per figure, and only if it has the words; the
    parts of a figure are then read from the short match.
    """
    pattern = ANY_CASE + V.REVENUE_FIGURE
    said = F.when(_has_any(F.upper(text), V.REVENUE_NEEDS), F.regexp_extract(text, pattern, 0))

    def revenue(said: Column) -> Column:
        number = F.replace(F.regexp_extract(said, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        return F.concat(F.lit("$"), float_text(number), F.upper(F.substring(F.regexp_extract(said, pattern, 2), 1, 1)))

    early = clip(text, V.EPS_SEARCH_LENGTH)
    eps = F.when(_has_any(F.upper(early), V.EPS_NEEDS), F.regexp_extract(early, ANY_CASE + V.EPS_FIGURE, 1))
    found = F.create_map(
        F.lit("revenue_mentioned"), F.get(F.transform(F.array(F.nullif(said, F.lit(""))), revenue), F.lit(0)),
        F.lit("eps_mentioned"), F.nullif(F.concat(F.lit("$"), eps), F.lit("$")),
    )
    return F.map_filter(found, lambda _, v: v.isNotNull())


def financials_chunk(text: Column) -> Column:
    """The stretch most likely to hold figures, around the first marker by priority."""
    rest = F.coalesce(*[F.nullif(rest_from(text, m), F.lit("")) for m in V.FINANCIALS_MARKERS])
    before = F.coalesce(F.length(text) - F.length(rest), F.lit(0))
    start = F.greatest(F.lit(0), before - V.CHUNK_BEFORE) + 1
    return F.substring(text, start, F.lit(V.CHUNK_LENGTH))


def round_to_tenth(number: Column) -> Column:
    """Round a double to one decimal by its exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed value, so 2.65 (stored a little
    below) would go up. Here the distance to the tie is computed without error:
    the number is split in two halves whose products by 20 are exact.
    """
    number = number.cast("double")
    high = (number * 134217729.0) - (number * 134217729.0 - number)
    low = number - high
    floor = F.floor(number * 10.0).cast("double")
    side = (high * 20.0 - (floor * 2.0 + 1.0)) + low * 20.0
    odd = F.pmod(floor, F.lit(2.0)) == 1.0
    up = (side > 0) | ((side == 0) & odd)
    return F.when(number.isNull(), None).otherwise((floor + F.when(up, 1.0).otherwise(0.0)) / 10.0)


def in_billions(amount: Column) -> Column:
    """A plain amount in billions, not yet rounded; zero counts as missing."""
    return F.nullif(amount.cast("double"), F.lit(0.0)) / 1e9


def to_billions(amount: Column) -> Column:
    return round_to_tenth(in_billions(amount))


def lookup_default(table: dict, key: Column, default: Column) -> Column:
    """A key's value in a small fixed table, or the default when it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def upper_ticker(ticker: Column) -> Column:
    return F.upper(ticker)


def document_file(ticker: Column) -> Column:
    return F.concat(F.lower(ticker), F.lit(".json"))


def transcript_file(year: Column, quarter: Column) -> Column:
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit("_"), year.cast("string"), F.lit(".json"))


def memo_file(ticker: Column, at: Column) -> Column:
    return F.concat(ticker, F.lit("_memo_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".md"))
