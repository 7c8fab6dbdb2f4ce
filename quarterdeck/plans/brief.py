"""Briefs: two analyses and a memo for every company with at least one quarter."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions import prompts as P
from quarterdeck.operators import briefs as B
from quarterdeck.operators import quarters as QT
from quarterdeck.operators.completion import OUTCOME, complete, complete_stored


def _answered(asked: DataFrame, label: str, system: str, user: Column, name: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with one more answer; the seconds it took are added to ``spent``."""
    prompts = asked.select("*", F.lit(label).alias("label"), F.lit(system).alias("system"), user.alias("user"))
    replies = answer(prompts)
    spent = F.col("spent") + F.coalesce("latency", F.lit(0.0))
    done = replies.withColumn("spent", spent).withColumnRenamed("reply", name)
    outcome = [f.name for f in OUTCOME if f.name != "reply"]
    return done.drop("label", "system", "user", "result_chars", *outcome)


def brief_companies(
    docs: DataFrame, fn: Callable, at: Column, by: str = "date", settle: Callable[[DataFrame], DataFrame] | None = None,
    store: str | None = None, **completion,
) -> DataFrame:
    """One brief per document with quarters: earnings, then sentiment, then the memo over both.

    A document has all its prompts need, so the three calls follow each other in
    its own row and nothing is shuffled or joined (but by a store). ``settle`` (for instance
    ``operators.shared.settled``) is put on the replies of each step, or
    ``store`` names a reply store (``operators.completion.complete_stored``);
    one of them is needed, so that costly calls are made once even when tasks
    are lost.
    """
    if store is not None:
        def answer(prompts):
            return complete_stored(prompts, fn, store, **completion)
    elif settle is not None:
        def answer(prompts):
            return settle(complete(prompts, fn, **completion))
    else:
        raise ValueError("briefs need settle or store: their replies are used more than once")
    two = docs.select("company", "ticker", "news", QT.latest_records(F.col("transcripts"), 2, by).alias("two"))
    now, before = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    asked = two.filter(F.size("two") > 0).select(
        "company", "ticker", now["quarter"].alias("quarter"), before["quarter"].alias("previous_quarter"),
        P.earnings_prompt(now, before).alias("earnings_user"),
        P.sentiment_prompt(F.col("company"), F.col("ticker"), F.col("news")).alias("sentiment_user"),
        F.lit(0.0).alias("spent"),
    )
    analysed = _answered(
        asked, "earnings-analyzer", P.EARNINGS_SYSTEM, F.col("earnings_user"), "earnings_analysis", answer
    ).drop("earnings_user")
    sensed = _answered(
        analysed, "sentiment-narrative", P.SENTIMENT_SYSTEM, F.col("sentiment_user"), "sentiment_analysis", answer
    ).drop("sentiment_user")
    question = P.memo_prompt(
        F.col("company"), F.col("ticker"), F.col("earnings_analysis"), F.col("sentiment_analysis")
    )
    return B.assemble_brief(
        _answered(sensed, "memo-generator", P.MEMO_SYSTEM, question, "memo", answer), at
    )
