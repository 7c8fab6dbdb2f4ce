"""Queries on prompts, completions, memos and briefs."""

import itertools

from pyspark.sql import functions as F

from quarterdeck.functions import prompts as PR
from quarterdeck.functions import text as X
from quarterdeck.operators import briefs as B
from quarterdeck.operators import pages as P
from quarterdeck.operators import quarters as QT
from quarterdeck.operators.completion import complete, complete_stored, observed, observed_stats, run_stats as stats_of
from quarterdeck.operators.shared import scratch_folder, settled
from quarterdeck.plans.brief import brief_companies
from quarterdeck.queries.catalog import NEWS_SQL, RECORDS_SQL, documents
from quarterdeck.queries.pages import BLOCKS_SQL, PAGE_NAMES_SQL, TEXTS_SQL, blocks, chunk_sql
from quarterdeck.queries.quarters import rich_quarters
from quarterdeck.queries.registry import query, text
from quarterdeck.queries.views import table

AT = "2002-01-01 09:30:05"


def count_words(system: str, user: str):
    """Stands in for a model: a repeatable reply, with token counts, and a failure now and then."""
    if not user or user.startswith("É"):
        raise ValueError("no answer")
    return f"{len(user)} of {len(system)}", len(user), 3


_LOOKS = [0]


def quarter_seconds() -> float:
    """Stands in for a clock: a quarter of a second passes from one look to the next."""
    _LOOKS[0] += 1
    return _LOOKS[0] / 4


def reply_sql(user: str, system: str) -> str:
    return (
        f"CASE WHEN {user} = '' OR {user} LIKE 'É%' THEN '' ELSE length({user}) || ' of ' || "
        f"length({text(system)}) END"
    )


_FIGURES = """CASE WHEN {r}.q IS NULL THEN NULL ELSE '{{' || chr(10) || '  "lines": ' || {r}.n_lines || ',' || chr(10) ||
    '  "revenue_bn": ' || CASE WHEN {r}.n_lines > 1 THEN cast({r}.revenue AS string) ELSE 'null' END || ',' || chr(10) ||
    '  "missed": ' || CASE WHEN {r}.n_lines > 4 THEN 'true' ELSE 'false' END || ',' || chr(10) ||
    '  "note": "\\u201c' || {r}.sector || '\\" mix"' || chr(10) || '}}' END"""
_QUOTES = """CASE WHEN {r}.n_lines > 2 THEN '- ' || {r}.company || ' (Lines): "' || {r}.n_lines || ' lines"' || chr(10) ||
    '- ' || {r}.company || ' (Trade): "' || {r}.sector || '"' || chr(10) ELSE '' END"""
_THEMES = """'- ' || {r}.sector || chr(10) || '- Quarter ' || {r}.quarter || chr(10)"""
_RISKS = """CASE WHEN {r}.n_lines > 3 THEN '- Many lines' || chr(10) ELSE '' END"""


def _part(template: str, row: str) -> str:
    return template.replace("{r}", row)


def _lines(*parts: str) -> str:
    return " || ".join(parts)


NL, NL2 = "chr(10)", "chr(10) || chr(10)"
TONE = "CASE WHEN {r}.n_lines > 1 THEN 'firm' ELSE 'N/A' END"
EARNINGS_SQL = _lines(
    "'## Current Quarter: ' || c.quarter || ' (' || c.date || ')'", NL2,
    "'**Speakers:** ' || c.company || ' (CEO), ' || c.sector || ' Desk (CFO)'", NL2,
    "'**Financials:** '", _part(_FIGURES, "c"), NL2, "'**Tone:** '", _part(TONE, "c"), NL2,
    "'**Key Themes:**'", NL, _part(_THEMES, "c"), NL, "'**Key Quotes:**'", NL, _part(_QUOTES, "c"), NL,
    "'**Risks:**'", NL, _part(_RISKS, "c"),
) + " || CASE WHEN p.quarter IS NULL THEN '' ELSE " + _lines(
    NL, "'---'", NL2, "'## Previous Quarter: ' || p.quarter || ' (' || p.date || ')'", NL2,
    "'**Financials:** '", _part(_FIGURES, "p"), NL2, "'**Tone:** '", _part(TONE, "p"), NL2,
    "'**Key Themes:**'", NL, _part(_THEMES, "p"), NL, "'**Risks:**'", NL, _part(_RISKS, "p"), NL,
    "'**Key Quotes:**'", NL, _part(_QUOTES, "p"),
) + " END"
EARNINGS_SQL = EARNINGS_SQL.replace("c.q IS NULL", "c.quarter IS NULL").replace("p.q IS NULL", "p.quarter IS NULL")
EARNED_SQL = f"""
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, pos DESC) AS n FROM {{f_quarter}}),
    earned AS (SELECT c.ticker, c.quarter, p.quarter AS previous_quarter, {EARNINGS_SQL} AS user
               FROM r c LEFT JOIN r p ON p.ticker = c.ticker AND p.n = 2 WHERE c.n = 1)"""


@query("WITH " + EARNED_SQL + " SELECT ticker, quarter, previous_quarter, user FROM earned")
def earnings_prompts(spark, folder):
    prompts = B.earnings_prompts(QT.pair_latest(rich_quarters(spark, folder), by="date"))
    return prompts.select("ticker", "quarter", "previous_quarter", "user")


SENSED_SQL = NEWS_SQL + """,
    parts AS (SELECT ticker, string_agg('### ' || headline || chr(10) || '**Date:** ' || date || ' | **Source:** '
        || source || chr(10) || chr(10) || snippet || chr(10) || chr(10) || '**Tags:** ' || replace(tags, '|', ', ')
        || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY filing_no) AS items
        FROM event_news GROUP BY ticker),
    sensed AS (SELECT c.ticker, c.company, '# ' || company || ' (' || c.ticker || ') — Recent News Flow' || chr(10)
        || chr(10) || coalesce(items, '') AS user FROM {f_company} c LEFT JOIN parts p ON p.ticker = c.ticker)"""


@query("WITH " + SENSED_SQL + " SELECT ticker, company, user FROM sensed")
def sentiment_prompts(spark, folder):
    return B.sentiment_prompts(documents(spark, folder, figures=False)).select("ticker", "company", "user")


def _about_sql(company="company", ticker="ticker"):
    return f"'Company: ' || {company} || ' (' || {ticker} || ')' || chr(10)"


def _fields_sql(fields, label):
    head, tail = fields.split("%s")
    return f"{text(head)} || {label} || {text(tail)}"


@query("WITH " + BLOCKS_SQL + f"""
    SELECT ticker, query_no::bigint AS query_no, {_about_sql("'Co ' || ticker")} || 'Quarter: Q1 2001' || chr(10) || chr(10)
        || 'Search results about this earnings call:' || chr(10) || '---' || chr(10) || substr(snippets, 1, 4000)
        || chr(10) || '---' || chr(10) || chr(10)
        || 'Fill in this JSON object; null or an empty list where the results say nothing:' || chr(10)
        || {_fields_sql(PR.SNIPPET_QUARTER_FIELDS, "'Q1 2001'")} AS user FROM blocks""")
def snippet_prompts(spark, folder):
    quarters = blocks(spark, folder).select(
        "*", F.concat(F.lit("Co "), "ticker").alias("company"), F.lit("Q1 2001").alias("label"),
        F.col("query_no").alias("grid_no"),
    )
    prompts = B.snippet_quarter_prompts(quarters)
    return prompts.select("ticker", F.col("grid_no").cast("long").alias("query_no"), "user")


@query("WITH " + BLOCKS_SQL + f"""
    SELECT ticker, {_about_sql("'Co ' || ticker")} || chr(10) || 'News search results:' || chr(10) || '---' || chr(10)
        || substr(snippets, 1, 3000) || chr(10) || '---' || chr(10) || chr(10)
        || 'List at most 6 news items as JSON in this form:' || chr(10) || {text(PR.NEWS_FIELDS)} AS user FROM blocks""")
def news_prompts(spark, folder):
    made = B.news_prompts(blocks(spark, folder).withColumn("company", F.concat(F.lit("Co "), "ticker")))
    return made.select("ticker", "user")


@query(f"""
    SELECT event_no, 'Text:' || chr(10) || '---' || chr(10) || {chunk_sql("full_text")} || chr(10) || '---' || chr(10)
        || chr(10) || 'Find revenue in billions, its growth over a year in percent and earnings per share. '
        || 'Null where the text gives none, never 0. Reply in this form:' || chr(10) || {text(PR.FIGURES_FIELDS)} AS user
    FROM {{f_call}}""")
def figures_prompts(spark, folder):
    calls = table(spark, folder, "f_call").select(
        "event_no", F.col("event_no").cast("string").alias("ticker"), F.lit("Q1 2001").alias("label"),
        F.col("full_text").alias("text"),
    )
    return B.figures_prompts(calls).select(F.col("ticker").cast("long").alias("event_no"), "user")


@query("WITH " + TEXTS_SQL + f"""
    SELECT page_id, {_about_sql("'Co'", "page_id")} || 'Quarter: Q1 2001' || chr(10) || 'Known speakers: '
        || coalesce(nullif(array_to_string({PAGE_NAMES_SQL}, ', '), ''), 'unknown') || chr(10) || chr(10)
        || 'Earnings call text:' || chr(10) || '---' || chr(10) || substr(text, 1, 8000) || chr(10) || '---' || chr(10)
        || chr(10) || 'Fill in this JSON object with 3 to 6 quotes, word for word:' || chr(10)
        || {_fields_sql(PR.QUARTER_FIELDS, "'Q1 2001'")} AS user FROM texts""")
def page_prompts(spark, folder):
    pages = P.page_texts(table(spark, folder, "f_page").select("page_id", "url", "html"))
    quarters = pages.select(
        "page_id", "text", F.lit("Co").alias("company"), F.col("page_id").cast("string").alias("ticker"),
        F.lit("Q1 2001").alias("label"), X.page_speakers(F.col("text")).alias("page_speakers"),
    )
    return B.page_quarter_prompts(quarters).select(F.col("ticker").cast("long").alias("page_id"), "user")


COMPLETED_SQL = f"""
    answered AS (SELECT conv_id, turn, role, text, {reply_sql("text", "Be brief.")} AS reply FROM {{f_turn}})"""


def _asked(spark, folder):
    turns = table(spark, folder, "f_turn")
    return turns.select("conv_id", "turn", F.col("role").alias("label"), F.lit("Be brief.").alias("system"),
                        F.col("text").alias("user"))


def _completed(spark, folder):
    return complete(_asked(spark, folder), count_words, wait=0, clock=quarter_seconds)


@query("WITH " + COMPLETED_SQL + """
    SELECT conv_id, turn, role AS label, reply, CASE WHEN reply = '' THEN 3 ELSE 1 END::bigint AS attempts,
           CASE WHEN reply = '' THEN 0 ELSE length(text) END AS tokens_in, CASE WHEN reply = '' THEN 0 ELSE 3 END::bigint
           AS tokens_out, length(reply) AS result_chars FROM answered""")
def completed(spark, folder):
    """Every conversation turn as a prompt; some calls fail three times and give an empty reply."""
    return _completed(spark, folder).select(
        "conv_id", "turn", "label", "reply", F.col("attempts").cast("long").alias("attempts"), "tokens_in",
        "tokens_out", "result_chars",
    )


@query("WITH " + COMPLETED_SQL + """
    SELECT conv_id, turn, role AS label, reply, CASE WHEN reply = '' THEN 3 ELSE 1 END::bigint AS attempts,
           role = 'user' AND reply <> '' AS from_first_run FROM answered""")
def completed_resumed(spark, folder):
    """A run that got no further than the user turns, then one over all turns, on one store of replies."""
    prompts, store = _asked(spark, folder), scratch_folder(spark)
    complete_stored(prompts.filter("label = 'user'"), first_run, store, parts=8, wait=0)
    found = complete_stored(prompts, second_run, store, parts=8, wait=0)
    return found.select("conv_id", "turn", "label", F.regexp_replace("reply", "^(first|second) ", "").alias("reply"),
                        F.col("attempts").cast("long").alias("attempts"), F.col("reply").startswith("first ").alias("from_first_run"))


def first_run(system: str, user: str):
    reply, *tokens = count_words(system, user)
    return "first " + reply, *tokens


def second_run(system: str, user: str):
    reply, *tokens = count_words(system, user)
    return "second " + reply, *tokens


STATS_SQL = "WITH " + COMPLETED_SQL + """
    SELECT role AS label, count(*) AS calls, count(*) FILTER (reply = '') AS empty_replies,
           sum(CASE WHEN reply = '' THEN 3 ELSE 1 END)::bigint AS attempts,
           sum(CASE WHEN reply = '' THEN 0 ELSE length(text) END)::bigint AS tokens_in,
           sum(CASE WHEN reply = '' THEN 0 ELSE 3 END)::bigint AS tokens_out,
           sum(length(reply))::bigint AS result_chars, max(length(reply))::bigint AS longest_result,
           round(count(*) FILTER (reply <> '') / 4, 1) AS elapsed_seconds,
           round(count(*) FILTER (reply <> '') / 4 / count(*), 1) AS average_seconds,
           round(max(CASE WHEN reply <> '' THEN 0.25::double ELSE 0 END), 1) AS slowest_seconds
    FROM answered GROUP BY role"""


@query(STATS_SQL)
def run_stats(spark, folder):
    return stats_of(_completed(spark, folder))


@query(STATS_SQL)
def run_stats_observed(spark, folder):
    """The same counts, made while the replies are written."""
    labels = ["user", "assistant", "system"]
    replies, observation = observed(_completed(spark, folder), labels)
    replies.write.parquet(scratch_folder(spark))
    return observed_stats(spark, observation, labels)


@query(f"""
    WITH said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS asked,
                  string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant') AS told
                  FROM {{f_turn}} GROUP BY conv_id)
    SELECT cast(conv_id AS string) AS ticker, '# Research Inputs for Talk (' || conv_id || ')' || chr(10) || chr(10)
        || '## Earnings Transcript Analysis' || chr(10) || asked || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || '## Sentiment & Narrative Analysis' || chr(10) || told || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || 'Write one investment committee memo from both analyses.' AS user
    FROM said WHERE asked IS NOT NULL AND told IS NOT NULL""")
def memo_prompts(spark, folder):
    """All that each side of a conversation says, in order, as two analyses of one company."""
    turns = table(spark, folder, "f_turn")

    def said(role):
        each = turns.filter((F.col("role") == role) & F.col("text").isNotNull())
        in_order = F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n")
        mine = each.groupBy("conv_id").agg(in_order.alias("reply"))
        return mine.select(
            F.col("conv_id").cast("string").alias("ticker"), F.lit("Talk").alias("company"), F.lit("Q1").alias("quarter"),
            F.lit(None).cast("string").alias("previous_quarter"), "reply", F.lit(0.0).alias("latency"),
        )

    return B.memo_prompts(said("user"), said("assistant")).select("ticker", "user")


BRIEF_SQL = RECORDS_SQL + "," + SENSED_SQL + """,
    q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, filing_no ASC) AS n FROM records
          WHERE form = '10-Q'),
    shown AS (SELECT *, '{{' || chr(10) || '  "revenue_bn": ' || coalesce(revenue_bn::string, 'null') || ',' || chr(10)
        || '  "eps_reported": ' || coalesce(eps::string, 'null') || CASE WHEN net_income_bn IS NULL THEN '' ELSE ',' ||
        chr(10) || '  "net_income_bn": ' || net_income_bn::string END || chr(10) || '}}' AS figures FROM q),
    asked AS (SELECT c.ticker, c.quarter, p.quarter AS previous_quarter,
        '## Current Quarter: ' || c.quarter || ' (' || c.date || ')' || chr(10) || chr(10) || '**Speakers:** ' || chr(10)
        || chr(10) || '**Financials:** ' || c.figures || chr(10) || chr(10) || '**Tone:** ' || chr(10) || chr(10)
        || '**Key Themes:**' || chr(10) || chr(10) || '**Key Quotes:**' || chr(10) || chr(10) || '**Risks:**' || chr(10)
        || CASE WHEN p.quarter IS NULL THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) || '## Previous Quarter: '
        || p.quarter || ' (' || p.date || ')' || chr(10) || chr(10) || '**Financials:** ' || p.figures || chr(10)
        || chr(10) || '**Tone:** ' || chr(10) || chr(10) || '**Key Themes:**' || chr(10) || chr(10) || '**Risks:**'
        || chr(10) || chr(10) || '**Key Quotes:**' || chr(10) END AS user
        FROM shown c LEFT JOIN shown p ON p.ticker = c.ticker AND p.n = 2 WHERE c.n = 1),
    analysed AS (SELECT s.company, a.ticker, quarter, previous_quarter, """ + reply_sql("a.user", PR.EARNINGS_SYSTEM) + """
        AS earnings_analysis, """ + reply_sql("s.user", PR.SENTIMENT_SYSTEM) + """ AS sentiment_analysis
        FROM asked a JOIN sensed s ON s.ticker = a.ticker),
    memo AS (SELECT *, '# Research Inputs for ' || company || ' (' || ticker || ')' || chr(10) || chr(10)
        || '## Earnings Transcript Analysis' || chr(10) || earnings_analysis || chr(10) || chr(10) || '---' || chr(10)
        || chr(10) || '## Sentiment & Narrative Analysis' || chr(10) || sentiment_analysis || chr(10) || chr(10) || '---'
        || chr(10) || chr(10) || 'Write one investment committee memo from both analyses.' AS user FROM analysed)"""


def settled_in(spark):
    folder, number = scratch_folder(spark), itertools.count()
    return lambda replies: settled(replies, f"{folder}/{next(number)}")


@query("WITH " + BRIEF_SQL + """
    SELECT company, ticker, quarter, previous_quarter, earnings_analysis, sentiment_analysis,
           """ + reply_sql("user", PR.MEMO_SYSTEM) + """ AS memo, ticker || '_memo_20020101_093005.md' AS memo_file
    FROM memo""")
def briefs(spark, folder):
    """The brief of every company with quarters; the seconds are left out, as they do not repeat."""
    made = brief_companies(documents(spark, folder), count_words, F.lit(AT).cast("timestamp"), settle=settled_in(spark), wait=0)
    return made.drop("elapsed_seconds")
