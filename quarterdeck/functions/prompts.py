"""Prompt texts as columns: what a model is asked, put together per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import replies as R
from quarterdeck.functions import text as X

# --- reply layouts: section headings are fixed values, the wording is ours --
EARNINGS_SYSTEM = """You study earnings calls for professional investors.
Answer in markdown with these sections, in this order:
## Key Themes
## Key Financial Metrics
## Management Tone & Messaging
## Risks
## What Changed vs Last Quarter
## Notable Quotes
Give figures wherever the input has them. Say how the story shifted between the quarters, not only how the numbers did."""

SENTIMENT_SYSTEM = """You turn a company's news flow into the stories that move its stock.
Answer in markdown with these sections, in this order:
## Top 3 Narratives
## Overall Sentiment
## Emerging Risks
## 3 Things the Market May Be Missing
Rate the sentiment as Bullish, Bearish or Mixed and give the reasons."""

MEMO_SYSTEM = """You write memos for an investment committee from two finished analyses.
Answer in markdown under the heading "# IC Memo: [Company Name] ([Ticker])" with these sections, in this order:
## Investment Summary
## Key Drivers
## What Changed This Quarter
## Risks
## Opportunities
## Market May Be Missing
## Overall View
State a stance (Buy, Hold or Sell), a conviction (High, Medium or Low) and the reasons. Be short and definite."""

QUARTER_SYSTEM = "You extract data from earnings material. Use only what the given text says; reply with one JSON object and nothing else."
NEWS_SYSTEM = "You extract news items. Use only what the given text says; reply with one JSON array and nothing else."
FIGURES_SYSTEM = "You extract figures from earnings calls. Reply with one JSON object and nothing else."

# --- target fields of the extraction replies (fixed values) -----------------
QUARTER_FIELDS = """{
  "quarter": "%s",
  "date": "YYYY-MM-DD or null",
  "speakers": ["Name (Title)"],
  "key_quotes": [{"speaker": "", "theme": "", "text": ""}],
  "key_themes": [""],
  "risks": [""],
  "tone": "one sentence"
}"""
SNIPPET_QUARTER_FIELDS = """{
  "quarter": "%s",
  "date": "YYYY-MM-DD or null",
  "speakers": ["Name (Title)"],
  "financials": {"revenue_bn": null, "revenue_yoy_pct": null, "eps_reported": null, "eps_estimate": null},
  "key_quotes": [{"speaker": "", "theme": "", "text": ""}],
  "key_themes": [""],
  "risks": [""],
  "tone": "one sentence",
  "data_quality": "high, medium or low"
}"""
NEWS_FIELDS = '[{"date": "YYYY-MM-DD or null", "source": "", "headline": "", "snippet": "", "tags": [""]}]'
FIGURES_FIELDS = '{"revenue_bn": null, "revenue_yoy_pct": null, "eps_reported": null, "eps_estimate": null}'


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def _lines(items: Column, line) -> Column:
    """One line per item; a missing list gives no lines."""
    return F.coalesce(F.array_join(F.transform(items, line), ""), F.lit(""))


def _bullets(items: Column) -> Column:
    return _lines(items, lambda i: _text("- ", _shown(i), "\n"))


def _quotes(quotes: Column) -> Column:
    return _lines(
        quotes,
        lambda q: _text("- ", _shown(q["speaker"]), " (", _shown(q["theme"]), '): "', _shown(q["text"]), '"\n'),
    )


def _joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def _figures(record: Column) -> Column:
    return F.coalesce(R.figures_json(record["financials"]), F.lit("{}"))


def _heading(which: str, record: Column) -> Column:
    return _text(f"## {which} Quarter: ", _shown(record["quarter"]), " (", _shown(record["date"]), ")\n\n")


def earnings_prompt(current: Column, previous: Column) -> Column:
    """The current quarter and, when there is one, the quarter before it after a rule."""
    now = _text(
        _heading("Current", current),
        "**Speakers:** ", _joined(current["speakers"]), "\n\n",
        "**Financials:** ", _figures(current), "\n\n",
        "**Tone:** ", _shown(current["tone"]), "\n\n",
        "**Key Themes:**\n", _bullets(current["key_themes"]),
        "\n**Key Quotes:**\n", _quotes(current["key_quotes"]),
        "\n**Risks:**\n", _bullets(current["risks"]),
    )
    before = _text(
        "\n---\n\n", _heading("Previous", previous),
        "**Financials:** ", _figures(previous), "\n\n",
        "**Tone:** ", _shown(previous["tone"]), "\n\n",
        "**Key Themes:**\n", _bullets(previous["key_themes"]),
        "\n**Risks:**\n", _bullets(previous["risks"]),
        "\n**Key Quotes:**\n", _quotes(previous["key_quotes"]),
    )
    return _text(now, F.when(previous.isNotNull(), before).otherwise(F.lit("")))


def sentiment_prompt(company: Column, ticker: Column, news: Column) -> Column:
    items = _lines(
        news,
        lambda n: _text(
            "### ", _shown(n["headline"]), "\n**Date:** ", _shown(n["date"]), " | **Source:** ", _shown(n["source"]),
            "\n\n", _shown(n["snippet"]), "\n\n**Tags:** ", _joined(n["tags"]), "\n\n---\n\n",
        ),
    )
    return _text("# ", company, " (", ticker, ") — Recent News Flow\n\n", items)


def memo_prompt(company: Column, ticker: Column, earnings: Column, sentiment: Column) -> Column:
    return _text(
        "# Research Inputs for ", company, " (", ticker, ")\n\n## Earnings Transcript Analysis\n", earnings,
        "\n\n---\n\n## Sentiment & Narrative Analysis\n", sentiment,
        "\n\n---\n\nWrite one investment committee memo from both analyses.",
    )


def _about(company: Column, ticker: Column) -> Column:
    return _text("Company: ", company, " (", ticker, ")\n")


def snippet_quarter_prompt(company: Column, ticker: Column, label: Column, snippets: Column) -> Column:
    head, tail = SNIPPET_QUARTER_FIELDS.split("%s")
    return _text(
        _about(company, ticker), "Quarter: ", label, "\n\nSearch results about this earnings call:\n---\n",
        X.clip(snippets, V.CLIP_SNIPPETS), "\n---\n\nFill in this JSON object; null or an empty list where the "
        "results say nothing:\n", head, label, tail,
    )


def news_prompt(company: Column, ticker: Column, snippets: Column) -> Column:
    return _text(
        _about(company, ticker), "\nNews search results:\n---\n", X.clip(snippets, V.CLIP_NEWS),
        "\n---\n\nList at most 6 news items as JSON in this form:\n" + NEWS_FIELDS,
    )


def figures_prompt(text: Column) -> Column:
    return _text(
        "Text:\n---\n", X.financials_chunk(text), "\n---\n\nFind revenue in billions, its growth over a year in "
        "percent and earnings per share. Null where the text gives none, never 0. Reply in this form:\n"
        + FIGURES_FIELDS,
    )


def page_quarter_prompt(company: Column, ticker: Column, label: Column, speakers: Column, text: Column) -> Column:
    known = F.coalesce(F.nullif(F.array_join(speakers, ", "), F.lit("")), F.lit("unknown"))
    head, tail = QUARTER_FIELDS.split("%s")
    return _text(
        _about(company, ticker), "Quarter: ", label, "\nKnown speakers: ", known, "\n\nEarnings call text:\n---\n",
        X.clip(text, V.CLIP_PAGE), "\n---\n\nFill in this JSON object with 3 to 6 quotes, word for word:\n",
        head, label, tail,
    )
