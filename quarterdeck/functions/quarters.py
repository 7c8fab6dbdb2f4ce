"""Calendar-quarter columns. A quarter is carried as its first day where it can be."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import text as X


def quarter_start(year: Column, q: Column) -> Column:
    return F.make_date(year.cast("int"), (q.cast("int") - 1) * 3 + 1, F.lit(1))


def previous_quarter_start(start: Column) -> Column:
    return F.add_months(start, -3)


def completed_quarters(as_of: Column, n: int) -> Column:
    """First days of the last n finished quarters before a day, newest first."""
    current = F.trunc(as_of, "quarter")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.add_months(current, -3 * i))


def report_month_start(start: Column) -> Column:
    """First day of the month in which the results of a quarter are reported."""
    return F.add_months(start, 3)


def quarter_label(ticker: Column, year: Column, q: Column) -> Column:
    """``Q2 2024``; ``Q2 FY2024`` for fiscal-year tickers, one year on if it ends in January."""
    end_month = X.lookup_default(V.FISCAL_YEAR_END_MONTH, ticker, F.lit(None).cast("int"))
    year = year.cast("int")
    shown = F.when(end_month.isNull(), year.cast("string")).otherwise(
        F.concat(F.lit("FY"), F.when(end_month == 1, year + 1).otherwise(year).cast("string"))
    )
    return F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), shown)


def filing_quarter(period: Column, filing_date: Column) -> Column:
    """Struct (quarter, fiscal_year) of a filing, by the end of its period."""
    period = period.try_cast("date")
    known = F.concat(F.lit("Q"), F.quarter(period).cast("string"), F.lit(" "), F.year(period).cast("string"))
    return F.struct(
        F.coalesce(known, F.concat(F.lit("Filing "), filing_date.cast("string"))).alias("quarter"),
        F.coalesce(F.year(period).cast("string"), F.lit("")).alias("fiscal_year"),
    )


def parse_label(label: Column) -> Column:
    """Struct (year, q, is_fiscal) of a quarter label; nulls for ``Filing <date>``."""
    pattern = r"^Q([1-4]) (FY)?(\d{4})"
    return F.struct(
        F.regexp_extract(label, pattern, 3).try_cast("int").alias("year"),
        F.regexp_extract(label, pattern, 1).try_cast("int").alias("q"),
        (F.regexp_extract(label, pattern, 2) == "FY").alias("is_fiscal"),
    )


def call_date_text(visible: Column) -> Column:
    """The raw ``Month day year`` after a date heading; empty when there is none."""
    return F.regexp_extract(visible, X.PLAIN + V.CALL_DATE, 1)


def call_date(raw: Column) -> Column:
    """``July 23, 2025`` as a date; null when it is no date."""
    plain = F.regexp_replace(F.replace(raw, F.lit(","), F.lit("")), r"(?U)\s+", " ")
    return F.to_date(F.try_to_timestamp(F.initcap(plain), F.lit("MMMM d yyyy")))
