"""Transcript pages: choosing the page of a quarter, its text, the quality gate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import html as H
from quarterdeck.functions import quarters as Q
from quarterdeck.functions import text as X


def names_quarter(href: Column, title: Column, year: Column, q: Column) -> Column:
    """True when link or title speak of the quarter as ``q2-2025`` or ``q2 2025``."""
    where = F.lower(F.concat_ws(" ", F.coalesce(href, F.lit("")), F.coalesce(title, F.lit(""))))
    short, long = F.concat(F.lit("q"), q.cast("string")), year.cast("string")
    return F.contains(where, F.concat_ws("-", short, long)) | F.contains(where, F.concat_ws(" ", short, long))


def pick_page(
    hits: DataFrame, site: str = V.TRANSCRIPT_SITE, k: int = V.HITS_PER_PAGE_SEARCH, entity_match: bool = False
) -> DataFrame:
    """The first fitting hit of each (ticker, year, q): queries in order, hits by rank.

    ``rank`` counts from 1, and only the first k hits of a query count.
    The best hit is a minimum, combined before the shuffle. With
    ``entity_match`` the result also says whether link or title name the
    company; the choice does not depend on it.
    """
    fits = F.contains(F.lower("href"), F.lit(site)) & names_quarter(
        F.col("href"), F.col("title"), F.col("year"), F.col("q")
    )
    first = hits.filter((F.col("rank") <= k) & fits).groupBy("ticker", "year", "q").agg(
        F.min_by(F.struct("href", "title"), F.struct("query_no", "rank")).alias("hit")
    )
    picked = first.select("ticker", "year", "q", F.col("hit.href").alias("url"), F.col("hit.title").alias("title"))
    if entity_match:
        words = F.lower(F.concat_ws(" ", "url", "title"))
        picked = picked.withColumn("entity_match", F.contains(words, F.lower("ticker")))
    return picked


def page_texts(pages: DataFrame) -> DataFrame:
    """Adds ``text`` and ``date_text`` to pages, by the tree of their elements."""
    parts = pages.withColumn("_page", H.page_parts(F.col("html")))
    return parts.select(
        *pages.columns, F.col("_page.text").alias("text"), F.coalesce(Q.call_date_text(F.col("_page.visible")), F.lit("")).alias("date_text")
    )


def reject_reason() -> Column:
    """The first reason to leave a quarter out; null when it passes."""
    return (
        F.when(F.col("url").isNull(), "no transcript found")
        .when(F.coalesce(F.length("html"), F.lit(0)) == 0, "fetch failed")
        .when(F.coalesce(F.length("text"), F.lit(0)) < V.MIN_PAGE_TEXT, "extraction failed")
    )


def quality_gate(quarters: DataFrame) -> DataFrame:
    """Adds ``reject_reason``; keep the rows where it is null."""
    return quarters.withColumn("reject_reason", reject_reason())


def with_pages(grid: DataFrame, picked: DataFrame, pages: DataFrame) -> DataFrame:
    """Quarter grid with the chosen page and its text; quarters without one stay, with a reason.

    Pages nobody chose are dropped before their html is read into a tree, and a
    page that many quarters chose is read once. Quarters without a page get a
    key of their own, or they would all meet in one task as null keys.
    """
    own = F.concat_ws(" ", "ticker", F.col("year").cast("string"), F.col("q").cast("string"))
    chosen = grid.join(picked, ["ticker", "year", "q"], "left").withColumn("_page", F.coalesce("url", own))
    wanted = pages.join(picked.select("url").distinct(), "url", "left_semi")
    texts = page_texts(wanted).withColumnRenamed("url", "_page")
    return quality_gate(chosen.join(texts, "_page", "left").drop("_page"))


def page_facts(passed: DataFrame) -> DataFrame:
    """Adds call date, speakers and sections read from a page."""
    sections = X.page_sections(F.col("text"))
    return passed.select(
        "*",
        Q.call_date(F.col("date_text")).cast("string").alias("call_date"),
        X.page_speakers(F.col("text")).alias("page_speakers"),
        sections.alias("_s"),
    ).select("*", "_s.*").drop("_s")
