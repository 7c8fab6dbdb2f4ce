"""Queries on call texts."""

from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X
from quarterdeck.operators import calls as CA
from quarterdeck.plans.calls import call_records
from quarterdeck.queries.registry import query, strip, text
from quarterdeck.queries.views import table
from quarterdeck.sources.tables import read_transcript_events

CALL_COLUMNS = ["ticker", "company", "year", "quarter", "event_no", "conference_date", "full_text"]

NAMES_SQL = f"""list_sort(list_distinct(
    regexp_extract_all(full_text, {text(V.HANDED_OVER_TO)}, 1)
    || list_filter(list_transform(regexp_extract_all(full_text, {text(V.THANKED)}, 1), lambda n: trim(n)),
                   lambda n: contains(n, ' '))
    || regexp_extract_all(substr(full_text, 1, 3000), {text(V.NAME_AND_TITLE)}, 1)))"""
REST_SQL = "regexp_extract(full_text, " + text(f"(?i)(?:{V.CALL_QUESTIONS_START})(?s:.*)") + ")"
REVENUE = text("(?i)" + V.REVENUE_FIGURE)
FIGURES_SQL = f"""
    CASE WHEN unit <> '' AND number IS NOT NULL THEN '$' || cast(number AS string) || unit END AS revenue_mentioned,
    CASE WHEN eps <> '' THEN '$' || eps END AS eps_mentioned
    FROM (SELECT *, upper(substr(regexp_extract(full_text, {REVENUE}, 2), 1, 1)) AS unit,
          try_cast(replace(regexp_extract(full_text, {REVENUE}, 1), ',', '') AS double) AS number,
          regexp_extract(substr(full_text, 1, 5000), {text("(?i)" + V.EPS_FIGURE)}, 1) AS eps,
          {NAMES_SQL} AS names, {REST_SQL} AS rest FROM {{f_call}}) c"""


@query(f"SELECT event_no, array_to_string({NAMES_SQL}, '; ') AS speakers FROM {{f_call}}")
def call_speakers(spark, folder):
    calls = table(spark, folder, "f_call")
    return calls.select("event_no", F.array_join(X.call_speakers(F.col("full_text")), "; ").alias("speakers"))


SECTIONS_SQL = f"""
    CASE WHEN rest = '' THEN full_text ELSE {strip("substr(full_text, 1, length(full_text) - length(rest))")} END
        AS prepared_remarks, {strip("rest")} AS questions_and_answers"""


@query(f"SELECT event_no, {SECTIONS_SQL} FROM (SELECT event_no, full_text, {REST_SQL} AS rest FROM {{f_call}}) c")
def call_sections(spark, folder):
    calls = table(spark, folder, "f_call")
    return calls.select("event_no", X.call_sections(F.col("full_text")).alias("s")).select("event_no", "s.*")


@query("SELECT event_no, " + FIGURES_SQL)
def key_numbers(spark, folder):
    numbers = X.key_numbers(F.col("full_text"))
    return table(spark, folder, "f_call").select("event_no", numbers.alias("n")).select(
        "event_no", F.try_element_at("n", F.lit("revenue_mentioned")).alias("revenue_mentioned"),
        F.try_element_at("n", F.lit("eps_mentioned")).alias("eps_mentioned"),
    )


EIGHT_SQL = """WHERE event_no IN (SELECT event_no FROM (
        SELECT event_no, row_number() OVER (PARTITION BY ticker ORDER BY event_no) AS n FROM {f_call}) e WHERE n <= 8)"""


def _events_and_texts(spark, folder):
    calls = table(spark, folder, "f_call")
    return (
        calls.select("ticker", "company", "year", "quarter", "event_no", "conference_date"),
        calls.select("ticker", "year", "quarter", "full_text"),
    )


@query("""
    SELECT ticker, company, year::bigint AS year, quarter::bigint AS quarter, event_no, conference_date,
           length(full_text) AS n_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_no) AS n FROM {f_call}) c
    WHERE n <= 3 AND length(full_text) > 0""")
def transcript_events(spark, folder):
    events = read_transcript_events(*_events_and_texts(spark, folder), 3)
    return events.select(
        "ticker", "company", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"),
        "event_no", "conference_date", F.length("full_text").cast("long").alias("n_chars"),
    )


@query(f"""
    SELECT company, ticker, year::bigint AS year, quarter::bigint AS quarter,
           'Q' || quarter || ' ' || year AS quarter_label, coalesce(conference_date, '') AS conference_date,
           array_to_string(names, '; ') AS speakers, length(full_text) AS transcript_length, full_text, {SECTIONS_SQL},
           'earningscall' AS source, {FIGURES_SQL} {EIGHT_SQL}""")
def raw_transcripts(spark, folder):
    raw = call_records(*_events_and_texts(spark, folder), fetched_at=F.lit("2002-01-01").cast("timestamp"))
    numbers = F.col("key_numbers")
    return raw.select(
        "company", "ticker", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"),
        "quarter_label", "conference_date", F.array_join("speakers", "; ").alias("speakers"), "transcript_length",
        "full_text", "prepared_remarks", "questions_and_answers", "source",
        F.try_element_at(numbers, F.lit("revenue_mentioned")).alias("revenue_mentioned"),
        F.try_element_at(numbers, F.lit("eps_mentioned")).alias("eps_mentioned"),
    )


@query(f"""
    SELECT ticker, min(company) AS company, count(*) AS total_transcripts,
           string_agg('Q' || quarter || ' ' || year || ' ' || coalesce(conference_date, '') || ' '
               || length(full_text) || ' ' || array_to_string({NAMES_SQL}, ',') || ' Q' || quarter || '_' || year
               || '.json', '; ' ORDER BY event_no) AS calls
    FROM {{f_call}} {EIGHT_SQL} GROUP BY ticker""")
def transcript_index(spark, folder):
    raw = call_records(*_events_and_texts(spark, folder), fetched_at=F.lit("2002-01-01").cast("timestamp"))
    index = CA.transcript_index(raw)
    shown = F.transform("transcripts", lambda t: F.concat_ws(
        " ", t["quarter_label"], t["conference_date"], t["transcript_length"].cast("string"),
        F.array_join(t["speakers"], ","), t["file"]))
    return index.select("ticker", "company", "total_transcripts", F.array_join(shown, "; ").alias("calls"))


@query(f"""
    SELECT ticker, min(company) AS company, count(*) AS total_transcripts,
           string_agg('Q' || quarter || ' ' || year || ' ' || length(full_text), '; ' ORDER BY event_no) FILTER (n <= 8) AS calls
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_no) AS n FROM {{f_call}}) c GROUP BY ticker""")
def stored_calls(spark, folder):
    """All stored calls are counted, the first eight are listed."""
    raw = CA.raw_transcripts(table(spark, folder, "f_call"), fetched_at=F.lit("2002-01-01").cast("timestamp"))
    shown = F.transform("transcripts", lambda t: F.concat_ws(" ", t["quarter_label"], t["transcript_length"].cast("string")))
    return CA.transcript_index(raw).select("ticker", "company", "total_transcripts", F.array_join(shown, "; ").alias("calls"))


@query(f"""
    SELECT event_no, CASE WHEN event_no % 4 = 0 THEN company || ' Speaker'
                          ELSE array_to_string({NAMES_SQL}, '; ') END AS speakers,
           CASE WHEN event_no % 3 = 0 THEN 'given remarks' ELSE prepared_remarks END AS prepared_remarks,
           CASE WHEN event_no % 3 = 0 THEN 'given questions' ELSE questions_and_answers END AS questions_and_answers
    FROM (SELECT *, {SECTIONS_SQL} FROM (SELECT *, {REST_SQL} AS rest FROM {{f_call}}) a) c""")
def supplied_preferred(spark, folder):
    """Some calls bring speakers, some both sections, some only one section."""
    no = F.col("event_no")
    calls = table(spark, folder, "f_call").select(
        "*",
        F.when(no % 4 == 0, F.array(F.concat("company", F.lit(" Speaker"))))
        .when(no % 4 == 1, F.array().cast("array<string>")).alias("speakers"),
        F.when(no % 3 != 2, F.lit("given remarks")).alias("prepared_remarks"),
        F.when(no % 3 == 0, F.lit("given questions")).when(no % 3 == 1, F.lit("")).alias("questions_and_answers"),
    )
    return CA.prefer_supplied(calls).select(
        "event_no", F.array_join("speakers", "; ").alias("speakers"), "prepared_remarks", "questions_and_answers"
    )
