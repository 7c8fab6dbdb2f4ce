"""Search snippets and model replies: from hits to text blocks, from replies to records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck import schemas as S
from quarterdeck.functions import replies as R
from quarterdeck.functions import text as X
from quarterdeck.operators.catalog import quarter_record
from quarterdeck.operators.shared import ordered_list
from quarterdeck.sources.tables import top_hits


def _query(*parts) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def quarter_queries(grid: DataFrame) -> DataFrame:
    """The search of each quarter: company, ticker, label and fixed words."""
    text = _query(F.col("company"), F.col("ticker"), F.col("label"), "earnings call transcript highlights key quotes")
    return grid.select("*", F.lit(1).alias("query_no"), text.alias("query"))


def news_queries(companies: DataFrame, year: Column) -> DataFrame:
    text = _query(F.col("company"), F.col("ticker"), "news", year.cast("string"))
    return companies.select("*", F.lit(1).alias("query_no"), text.alias("query"))


def page_queries(grid: DataFrame, site: str = V.TRANSCRIPT_SITE) -> DataFrame:
    """Two searches of each quarter on the transcript site: by company, then by ticker."""
    quarter = F.concat(F.lit("Q"), F.col("q").cast("string"))
    year = F.col("year").cast("string")
    both = F.array(*[
        _query(f"site:{site}", F.col(who), quarter, year, "earnings call transcript") for who in ("company", "ticker")
    ])
    return grid.select("*", F.posexplode(both).alias("query_no", "query")).withColumn("query_no", F.col("query_no") + 1)


def snippet_blocks(hits: DataFrame, query: list[str], k: int = V.HITS_PER_QUARTER) -> DataFrame:
    """The first k hits of each query as one text, in rank order."""

    def part(heading: str, name: str) -> Column:
        return F.concat(F.lit(heading), F.coalesce(name, F.lit("")))

    lines = F.concat_ws(
        "\n", part("SOURCE: ", "href"), part("TITLE:  ", "title"), part("BODY:   ", "body"), F.lit("")
    )
    listed = top_hits(hits, k, query).groupBy(*query).agg(ordered_list(F.col("rank"), lines).alias("_lines"))
    return listed.select(*query, F.array_join("_lines", "\n").alias("snippets"))


def keep_searched(snippets: DataFrame) -> DataFrame:
    """Rows whose search gave text and did not fail."""
    text = F.col("snippets")
    return snippets.filter((F.length(X.strip(text)) > 0) & ~F.contains(text, F.lit(V.FAILED_SEARCH)))


def parse_quarter_replies(replies: DataFrame, label: str = "label", tier: int = 2) -> DataFrame:
    """Adds ``parse_ok``, ``parsed`` (a quarter struct) and ``given`` (which keys the reply had).

    A reply that is no JSON object becomes a fallback record with the asked
    label, empty lists and null date and tone; in tier 1 it is also marked as of
    low quality, with an error.
    """
    value, none = F.col("_value"), F.lit(None).cast("string")
    texts, quotes = R.empty("array<string>"), R.empty(R.QUOTES)
    fallback = quarter_record(
        quarter=F.col(label), speakers=texts, financials=R.empty("map<string,string>"), key_quotes=quotes,
        key_themes=texts, risks=texts, data_quality=F.lit("low" if tier == 1 else None),
        error=F.lit(V.PARSE_ERROR if tier == 1 else None),
    )
    parsed = quarter_record(
        quarter=R.field(value, "quarter", "string", F.col(label)),
        date=R.field(value, "date", "string", none),
        speakers=R.field(value, "speakers", "array<string>", texts),
        financials=R.field(value, "financials", "map<string,string>", R.empty("map<string,string>")),
        key_quotes=R.field(value, "key_quotes", R.QUOTES, quotes),
        key_themes=R.field(value, "key_themes", "array<string>", texts),
        risks=R.field(value, "risks", "array<string>", texts),
        tone=R.field(value, "tone", "string", none),
        data_quality=R.field(value, "data_quality", "string", none),
    )
    ok = value.isNotNull()
    return replies.withColumn("_value", R.as_object(F.col("reply"))).select(
        *replies.columns, ok.alias("parse_ok"), F.when(ok, parsed).otherwise(fallback).alias("parsed"),
        F.coalesce(R.has_key(value, "speakers"), F.lit(False)).alias("has_speakers"),
    )


def parse_news_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumn("news", R.news_items(F.col("reply")))


def parse_figures_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumn("financials", R.figures(F.col("reply")))


def merge_financials(quarters: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """The separately asked figures take the place of those of the quarter reply."""
    both = quarters.join(figures.select(*keys, "financials"), keys, "left")
    asked = F.coalesce(F.col("financials"), R.empty("map<string,string>"))
    return both.withColumn("parsed", F.col("parsed").withField("financials", asked)).drop("financials")


def assemble_quarters(parsed: DataFrame) -> DataFrame:
    """Adds ``record``: the parsed reply with what the page itself gave.

    The date of the page stands in for a missing or empty one. The speakers of
    the page stand in only when a readable reply has no such key; a reply that
    could not be read keeps its empty list, and an explicit null stays null.
    """
    p = F.col("parsed")
    own_speakers = F.when(F.col("parse_ok") & ~F.col("has_speakers"), F.col("page_speakers")).otherwise(p["speakers"])
    record = (
        p.withField("date", F.coalesce(F.nullif(p["date"], F.lit("")), F.col("call_date")))
        .withField("speakers", own_speakers)
        .withField("source_url", F.col("url"))
    )
    return parsed.withColumn("record", record.cast(S.QUARTER))


def extraction_stats(quarters: DataFrame, text: str = "text") -> DataFrame:
    """Per quarter: quotes, themes, speakers, length of the source text, quality."""

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.col("record")[name]), F.lit(0)).cast("long").alias(f"n_{name.removeprefix('key_')}")

    return quarters.select(
        "ticker", "label", count("key_quotes"), count("key_themes"), count("speakers"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.col("record.data_quality"), F.lit("?")).alias("data_quality"),
    )
