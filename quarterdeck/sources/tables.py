"""Stored results of the outside services: filings, facts, hits, pages, calls, company facts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V


def read_filings(filings: DataFrame, form: str) -> DataFrame:
    """Filings of one form; the condition reaches the scan."""
    return filings.filter(F.col("form") == form)


KEYS = ["accession", "ord", "label", "abstract", "dim"]


def read_statements(records: DataFrame) -> DataFrame:
    """Statement rows as their filings have them: (accession, ord, record) to the keys and ``periods``.

    ``record`` is the JSON object of one row: label, abstract, dimension, and a value under each period that this filing has.
    Filings differ in their periods, so these are not columns but a list of (period, val) in the order of the object;
    a key is a period when it begins with a digit. A value that is no number is null; a broken record has no periods.
    """
    read = records.select("accession", "ord", F.from_json("record", "map<string,string>").alias("_r"))
    periods = F.transform(
        F.filter(F.map_entries("_r"), lambda e: e["key"].rlike("^[0-9]")),
        lambda e: F.struct(e["key"].alias("period"), e["value"].try_cast("double").alias("val")),
    )
    return read.select(
        "accession", "ord", F.try_element_at("_r", F.lit("label")).alias("label"),
        (F.try_element_at("_r", F.lit("abstract")) == "true").alias("abstract"), F.try_element_at("_r", F.lit("dimension")).alias("dim"),
        F.coalesce(periods, F.array().cast("array<struct<period:string,val:double>>")).alias("periods"),
    )


def statement_facts(statements: DataFrame) -> DataFrame:
    """One row per (row, period); ``period_pos`` is the period's place in its own filing."""
    return statements.select(*KEYS, F.posexplode("periods").alias("period_pos", "p")).select(*KEYS, "p.period", "period_pos", "p.val")


def statement_first_period(statements: DataFrame) -> DataFrame:
    """Only the first period of each filing; rows without a period drop out."""
    first = statements.select(*KEYS, F.get("periods", F.lit(0)).alias("p")).filter("p is not null")
    return first.select(*KEYS, "p.period", F.lit(0).alias("period_pos"), "p.val")


def period_columns(facts_wide: DataFrame) -> list[str]:
    return [c for c in facts_wide.columns if c[:1].isdigit()]


def as_statements(facts_wide: DataFrame) -> DataFrame:
    """A table with a column for each period of any filing, as statement rows with the periods of their own filing.

    A column is a period when its name starts with a digit, and a filing has it when some row of the filing has a value
    there; which do is counted in one grouping, combined before the shuffle. A filing's row that is empty in
    one of its periods keeps the period, with null.
    """
    names = period_columns(facts_wide)
    if not names:
        return facts_wide.select(*KEYS, F.array().cast("array<struct<period:string,val:double>>").alias("periods"))
    held = facts_wide.groupBy(F.col("accession").alias("_of")).agg(*[F.count(F.col(f"`{n}`")).alias(f"_{i}") for i, n in enumerate(names)])
    own = held.select("_of", F.array(*[F.col(f"_{i}") > 0 for i in range(len(names))]).alias("_own"))
    values = F.array(*[F.struct(F.lit(n).alias("period"), F.col(f"`{n}`").cast("double").alias("val")) for n in names])
    rows = facts_wide.select(*KEYS, values.alias("_values")).join(own, F.col("accession").eqNullSafe(F.col("_of")))
    return rows.select(*KEYS, F.filter("_values", lambda v, i: F.get("_own", i)).alias("periods"))


def read_facts(facts_wide: DataFrame) -> DataFrame:
    """Statement rows with one column per period, as one row per (row, period of its filing); see ``as_statements``."""
    return statement_facts(as_statements(facts_wide))


def first_period(facts_wide: DataFrame) -> DataFrame:
    """Only the first period of each filing of a wide table."""
    return statement_first_period(as_statements(facts_wide))


def top_hits(hits: DataFrame, k: int, query: list[str]) -> DataFrame:
    """First k hits of each query. Each task keeps k rows per query before the shuffle."""
    by_rank = Window.partitionBy(*query).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(by_rank)).filter(F.col("_n") <= k).drop("_n")


def read_search_hits(hits: DataFrame, k: int = V.HITS_PER_QUARTER, query: list[str] | None = None) -> DataFrame:
    return top_hits(hits, k, query or ["query_id"])


def read_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages; a failed fetch has no html. Bytes are read as UTF-8, bad ones left out."""
    if dict(pages.dtypes)["html"] == "binary":
        text = F.replace(F.make_valid_utf8(F.col("html").cast("string")), F.lit("\ufffd"), F.lit(""))
        pages = pages.withColumn("html", text)
    return pages.filter(F.col("html").isNotNull())


def read_transcript_events(events: DataFrame, transcripts: DataFrame, n: int = V.QUARTERS) -> DataFrame:
    """First n events of a company in source order, with the call text of each.

    Events are cut to n before the join; an event without text drops out after
    the cut, so a company may keep fewer than n. Of several texts of a call the first by text counts. Texts of other
    calls go before anything is done with them.
    """
    in_order = Window.partitionBy("ticker").orderBy("event_no")
    first = events.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= n).drop("_n")
    call = ["ticker", "year", "quarter"]
    wanted = transcripts.filter(F.length("full_text") > 0).join(first.select(*call), call, "left_semi")
    others = [c for c in wanted.columns if c not in call]
    one = wanted.groupBy(*call).agg(F.min(F.struct("full_text", *[c for c in others if c != "full_text"])).alias("_text"))
    return first.join(one.select(*call, *[F.col(f"_text.{c}").alias(c) for c in others]), call, "inner")


def company_info(tickers: DataFrame, info: DataFrame) -> DataFrame:
    """(ticker, company, sector, industry) for every ticker, with defaults.

    The long name counts when it is not empty, else the short name when there is
    one, else the ticker; a ticker without any information gets all defaults.
    """
    known = tickers.join(info, "ticker", "left")
    return known.select(
        "ticker",
        F.coalesce(F.nullif("longName", F.lit("")), F.col("shortName"), F.col("ticker")).alias("company"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"),
    )
