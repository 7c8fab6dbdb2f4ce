"""Prompt tables of an investment brief and its result rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions import prompts as P
from quarterdeck.functions import text as X


def _prompts(df: DataFrame, keys: list, label: Column, system: str, user: Column) -> DataFrame:
    return df.select(*keys, label.alias("label"), F.lit(system).alias("system"), user.alias("user"))


def earnings_prompts(pairs: DataFrame) -> DataFrame:
    """One prompt per company from (ticker, current, previous)."""
    user = P.earnings_prompt(F.col("current"), F.col("previous"))
    keys = [
        "ticker", F.col("current.quarter").alias("quarter"), F.col("previous.quarter").alias("previous_quarter"),
    ]
    return _prompts(pairs, keys, F.lit("earnings-analyzer"), P.EARNINGS_SYSTEM, user)


def sentiment_prompts(docs: DataFrame) -> DataFrame:
    """One prompt per company from (company, ticker, news list)."""
    user = P.sentiment_prompt(F.col("company"), F.col("ticker"), F.col("news"))
    return _prompts(docs, ["ticker", "company"], F.lit("sentiment-narrative"), P.SENTIMENT_SYSTEM, user)


def memo_prompts(earnings: DataFrame, sentiment: DataFrame) -> DataFrame:
    """One prompt per company from its two analyses (``earnings``/``sentiment`` replies)."""
    seconds = F.coalesce("latency", F.lit(0.0))
    analysed = earnings.select(
        "ticker", "quarter", "previous_quarter", F.col("reply").alias("earnings_analysis"), seconds.alias("_first")
    )
    sensed = sentiment.select("ticker", "company", F.col("reply").alias("sentiment_analysis"), seconds.alias("_second"))
    both = analysed.join(sensed, "ticker", "inner").withColumn("spent", F.col("_first") + F.col("_second"))
    user = P.memo_prompt(
        F.col("company"), F.col("ticker"), F.col("earnings_analysis"), F.col("sentiment_analysis")
    )
    keys = ["company", "ticker", "quarter", "previous_quarter", "earnings_analysis", "sentiment_analysis", "spent"]
    return _prompts(both, keys, F.lit("memo-generator"), P.MEMO_SYSTEM, user)


def snippet_quarter_prompts(quarters: DataFrame) -> DataFrame:
    user = P.snippet_quarter_prompt(F.col("company"), F.col("ticker"), F.col("label"), F.col("snippets"))
    name = F.concat_ws("-", F.lit("transcript"), "ticker", "label")
    keys = ["ticker", "company", "grid_no", F.col("label").alias("quarter_label")]
    return _prompts(quarters, keys, name, P.QUARTER_SYSTEM, user)


def news_prompts(snippets: DataFrame) -> DataFrame:
    user = P.news_prompt(F.col("company"), F.col("ticker"), F.col("snippets"))
    return _prompts(snippets, ["ticker"], F.concat_ws("-", F.lit("news"), "ticker"), P.NEWS_SYSTEM, user)


def figures_prompts(quarters: DataFrame) -> DataFrame:
    name = F.concat_ws("-", F.lit("t2-fin"), "ticker", "label")
    keys = ["ticker", F.col("label").alias("quarter_label")]
    return _prompts(quarters, keys, name, P.FIGURES_SYSTEM, P.figures_prompt(F.col("text")))


def page_quarter_prompts(quarters: DataFrame) -> DataFrame:
    user = P.page_quarter_prompt(
        F.col("company"), F.col("ticker"), F.col("label"), F.col("page_speakers"), F.col("text")
    )
    name = F.concat_ws("-", F.lit("t2-extract"), "ticker", "label")
    keys = ["ticker", F.col("label").alias("quarter_label")]
    return _prompts(quarters, keys, name, P.QUARTER_SYSTEM, user)


def assemble_brief(memos: DataFrame, at: Column) -> DataFrame:
    """The nine result fields; ``at`` is the time that names the memo file, ``spent`` the seconds of the calls."""
    return memos.select(
        "company", "ticker", "quarter", "previous_quarter", "earnings_analysis", "sentiment_analysis",
        "memo",
        X.memo_file(F.col("ticker"), at).alias("memo_file"),
        X.round_to_tenth(F.col("spent")).alias("elapsed_seconds"),
    )
