"""Transcript pages and search snippets to company documents."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.operators import briefs as B
from quarterdeck.operators import catalog as C
from quarterdeck.operators import extraction as E
from quarterdeck.operators import pages as P
from quarterdeck.operators import quarters as QT
from quarterdeck.operators.completion import complete
from quarterdeck.operators.shared import settled


def page_quarters(
    companies: DataFrame, hits: DataFrame, pages: DataFrame, as_of: Column, n: int = V.QUARTERS,
    site: str = V.TRANSCRIPT_SITE,
) -> DataFrame:
    """The quarter grid with its pages: text, date, speakers, sections or a reject reason."""
    grid = QT.quarter_grid(companies, as_of, n)
    return P.page_facts(P.with_pages(grid, P.pick_page(hits, site), pages))


def pages_to_documents(
    companies: DataFrame, hits: DataFrame, pages: DataFrame, fn: Callable, as_of: Column, n: int = V.QUARTERS,
    site: str = V.TRANSCRIPT_SITE, reply_path: str | None = None, **completion,
) -> DataFrame:
    """Documents from transcript pages; two completions per kept quarter.

    Kept quarters and replies are settled once each, since both prompts and the
    records need them.
    """
    path = (lambda name: f"{reply_path}/{name}") if reply_path else (lambda name: None)
    rows = page_quarters(companies, hits, pages, as_of, n, site).filter(F.col("reject_reason").isNull())
    kept = settled(rows.drop("html", "reject_reason", "prepared_remarks", "questions_and_answers"), path("quarters"))
    keys = ["ticker", "quarter_label"]
    replies = settled(complete(B.page_quarter_prompts(kept), fn, **completion), path("quarter_replies"))
    figures = settled(complete(B.figures_prompts(kept), fn, **completion), path("figure_replies"))
    named = kept.withColumn("quarter_label", F.col("label"))
    parsed = E.parse_quarter_replies(named.join(replies.select(*keys, "reply"), keys), "quarter_label", tier=2)
    merged = E.merge_financials(parsed, E.parse_figures_replies(figures), keys)
    quarters = C.collect_quarters(E.assemble_quarters(merged), F.col("grid_no"), F.col("record"))
    info = companies.select("ticker", "company", "sector")
    return C.assemble_company(info, quarters, last_updated=as_of)


def snippets_to_documents(
    companies: DataFrame, quarter_hits: DataFrame, news_hits: DataFrame, fn: Callable, as_of: Column,
    n: int = V.QUARTERS, fetcher: Column | None = None, reply_path: str | None = None, **completion,
) -> DataFrame:
    """Documents from search snippets; one completion per kept quarter and one per company for news."""
    path = (lambda name: f"{reply_path}/{name}") if reply_path else (lambda name: None)
    grid = QT.quarter_grid(companies, as_of, n)
    blocks = E.snippet_blocks(quarter_hits, ["ticker", "year", "q"], V.HITS_PER_QUARTER)
    kept = E.keep_searched(grid.join(blocks, ["ticker", "year", "q"], "inner"))
    replies = settled(complete(B.snippet_quarter_prompts(kept), fn, **completion), path("quarter_replies"))
    parsed = E.parse_quarter_replies(replies, "quarter_label", tier=1)
    quarters = C.collect_quarters(parsed, F.col("grid_no"), F.col("parsed"))
    # a company whose news search found nothing is still asked, with an empty text
    news_blocks = companies.join(E.snippet_blocks(news_hits, ["ticker"], V.HITS_PER_NEWS), "ticker", "left").na.fill(
        "", ["snippets"]
    )
    asked = settled(complete(B.news_prompts(news_blocks), fn, **completion), path("news_replies"))
    news = E.parse_news_replies(asked).select("ticker", "news")
    info = companies.select("ticker", "company", "sector", "industry")
    return C.assemble_company(info, quarters, news, last_updated=as_of, fetcher=fetcher)
