"""Filings to company documents and registry updates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X
from quarterdeck.operators import catalog as C
from quarterdeck.operators import filings as FL


def seed_companies(
    companies: DataFrame, filings: DataFrame, facts: DataFrame | None, n_quarters: int = V.QUARTERS,
    last_updated: Column | None = None,
) -> DataFrame:
    """Documents with the latest 10-Q quarters, 10-K years and 8-K news of each company.

    ``companies`` has (ticker, company, sector).
    """
    info = companies.select(X.upper_ticker(F.col("ticker")).alias("ticker"), "company", "sector")
    return C.assemble_company(FL.document_lists(info, filings, facts, n_quarters), last_updated=last_updated)


def registry_updates(docs: DataFrame, update_no: Column) -> DataFrame:
    return docs.select(
        "ticker", F.col("company").alias("name"),
        F.coalesce(F.size("transcripts"), F.lit(0)).cast("long").alias("transcript_count"),
        F.coalesce(F.size("news"), F.lit(0)).cast("long").alias("news_items"),
        update_no.alias("update_no"),
    )
