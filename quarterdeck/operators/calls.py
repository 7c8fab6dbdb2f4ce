"""Earnings calls: raw transcript records and the index of a company's calls."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck import schemas as S
from quarterdeck.functions import text as X
from quarterdeck.operators.shared import ordered_list


def prefer_supplied(calls: DataFrame) -> DataFrame:
    """Speakers and sections as supplied, else as read from the text.

    Supplied speakers count when there are any; supplied sections count only
    when both are there.
    """
    supplied = calls.schema.names

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in supplied else F.lit(None).cast(kind)

    remarks, questions = given("prepared_remarks", "string"), given("questions_and_answers", "string")
    both = (F.coalesce(F.length(remarks), F.lit(0)) > 0) & (F.coalesce(F.length(questions), F.lit(0)) > 0)
    names = given("speakers", "array<string>")
    has_names = F.coalesce(F.size(names), F.lit(0)) > 0
    text = F.col("full_text")
    sections = F.when(
        both, F.struct(remarks.alias("prepared_remarks"), questions.alias("questions_and_answers"))
    ).otherwise(X.call_sections(text))
    kept = [c for c in calls.columns if c not in ("speakers", "prepared_remarks", "questions_and_answers")]
    return calls.select(
        *kept, F.when(has_names, names).otherwise(X.call_speakers(text)).alias("speakers"), sections.alias("_sections")
    ).select(*kept, "speakers", "_sections.*")


def raw_transcripts(calls: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """The 14-field record of each call."""
    q, year = F.col("quarter").cast("string"), F.col("year").cast("string")
    return prefer_supplied(calls).select(
        "company",
        X.upper_ticker(F.col("ticker")).alias("ticker"),
        "year",
        "quarter",
        F.concat(F.lit("Q"), q, F.lit(" "), year).alias("quarter_label"),
        F.coalesce(F.col("conference_date").cast("date").cast("string"), F.lit("")).alias("conference_date"),
        "speakers",
        F.length("full_text").cast("long").alias("transcript_length"),
        X.key_numbers(F.col("full_text")).cast(S.FIGURES).alias("key_numbers"),
        "full_text",
        "prepared_remarks",
        "questions_and_answers",
        (F.current_timestamp() if fetched_at is None else fetched_at).alias("fetched_at"),
        F.lit(V.CALL_SOURCE).alias("source"),
        *[c for c in ("event_no",) if c in calls.columns],
    )


def transcript_index(raw: DataFrame, n: int | None = V.QUARTERS) -> DataFrame:
    """Per company: how many calls are stored, and a short entry for each of the first n in source order (None: for all).

    Stored records without ``event_no`` are in the order of year and quarter. The long texts are not among the columns.
    Calls are counted before the cut, by numbers combined before the shuffle; each task sends n entries of a company on,
    so a company with a third of all calls costs no more than another.
    """
    order = [*(["event_no"] if "event_no" in raw.columns else []), "year", "quarter"]
    place = Window.partitionBy("ticker").orderBy(*order)
    raw = raw.drop("full_text", "prepared_remarks", "questions_and_answers")
    counts = raw.groupBy("ticker").agg(F.min("company").alias("company"), F.max("fetched_at").alias("fetched_at"), F.count("*").alias("total_transcripts"))
    placed = raw.withColumn("_place", F.row_number().over(place))
    entry = F.struct(
        "quarter_label", "conference_date", "speakers", "transcript_length", "key_numbers",
        X.transcript_file(F.col("year"), F.col("quarter")).alias("file"),
    )
    listed = (placed if n is None else placed.filter(F.col("_place") <= n)).groupBy("ticker").agg(ordered_list(F.col("_place"), entry).alias("transcripts"))
    return counts.join(listed.withColumnRenamed("ticker", "_of"), F.col("ticker").eqNullSafe(F.col("_of"))).drop("_of")
