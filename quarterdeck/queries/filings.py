"""Queries on filings and their statement facts."""

from pyspark.sql import functions as F

from quarterdeck.operators import filings as FL
from quarterdeck.queries.catalog import FIGURES_SQL, NEWS_SQL, RECORDS_SQL
from quarterdeck.queries.registry import query
from quarterdeck.queries.views import table
from quarterdeck.sources.tables import first_period, read_facts, read_filings, read_statements, statement_facts, statement_first_period

# of every seventh filing the newer period is missing, as in a table of filings of different years
WIDE = """
    wide AS (SELECT accession, ord, label, abstract, dim, CASE WHEN cast(accession AS bigint) % 7 > 0 THEN val END AS "2001-06-30",
             val / 2 AS "2000-06-30" FROM {f_fact}),
    held AS (SELECT accession, count("2001-06-30") > 0 AS newer, count("2000-06-30") > 0 AS older FROM wide GROUP BY accession)"""


def _wide(spark, folder):
    facts = table(spark, folder, "f_fact")
    newer = F.when(F.col("accession").cast("long") % 7 > 0, F.col("val"))
    return facts.select("accession", "ord", F.lit("USD").alias("unit"), "label", "abstract", "dim",
                        newer.alias("2001-06-30"), (F.col("val") / 2).alias("2000-06-30"))


@query("WITH " + WIDE + """
    SELECT accession, ord, label, CASE WHEN newer THEN '2001-06-30' ELSE '2000-06-30' END AS period,
           CASE WHEN newer THEN "2001-06-30" ELSE "2000-06-30" END AS val
    FROM wide JOIN held USING (accession) WHERE newer OR older""")
def facts_first_period(spark, folder):
    return first_period(_wide(spark, folder)).select("accession", "ord", "label", "period", "val")


@query("WITH " + WIDE + """
    SELECT accession, ord, '2001-06-30' AS period, 0::bigint AS period_pos, "2001-06-30" AS val FROM wide JOIN held USING (accession) WHERE newer
    UNION ALL SELECT accession, ord, '2000-06-30', newer::int::bigint, "2000-06-30" FROM wide JOIN held USING (accession) WHERE older""")
def facts_long(spark, folder):
    long = read_facts(_wide(spark, folder))
    return long.select("accession", "ord", "period", F.col("period_pos").cast("long").alias("period_pos"), "val")


@query("""
    SELECT accession, ord, 'Line ' || line AS label, is_abstract AS abstract, CASE kind WHEN 0 THEN '2001-06-30' ELSE '1999-12-31' END AS period,
           CASE kind WHEN 0 THEN newest ELSE older END AS val
    FROM {f_statement} WHERE kind < 2""")
def statement_first(spark, folder):
    """The first period of every filing, whatever periods the others have."""
    first = statement_first_period(read_statements(table(spark, folder, "f_statement")))
    return first.select("accession", "ord", "label", "abstract", "period", "val")


@query("""
    SELECT accession, ord, CASE kind WHEN 0 THEN '2001-06-30' ELSE '1999-12-31' END AS period, 0::bigint AS period_pos,
           CASE kind WHEN 0 THEN newest ELSE older END AS val FROM {f_statement} WHERE kind < 2
    UNION ALL SELECT accession, ord, '2000-06-30', 1, older FROM {f_statement} WHERE kind = 0""")
def statement_periods(spark, folder):
    """Every row of every filing under each period of its own filing."""
    facts = statement_facts(read_statements(table(spark, folder, "f_statement")))
    return facts.select("accession", "ord", "period", F.col("period_pos").cast("long").alias("period_pos"), "val")


@query("WITH " + FIGURES_SQL + """
    SELECT accession, period, revenue, net_income, eps_diluted FROM chained""")
def classified_facts(spark, folder):
    return FL.classify_facts(table(spark, folder, "f_fact"))


@query("WITH " + FIGURES_SQL + """
    SELECT f.accession, form, revenue_bn, eps, net_income_bn
    FROM {f_filing} f LEFT JOIN figures g ON g.accession = f.accession""")
def filing_financials(spark, folder):
    filed = FL.with_figures(table(spark, folder, "f_filing"), FL.classify_facts(table(spark, folder, "f_fact")))
    return filed.select("accession", "form", "revenue_bn", "eps", "net_income_bn")


@query("""
    SELECT ticker, accession, form, cast(filing_date AS string) AS filing_date, n AS filing_no
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, accession DESC) AS n
          FROM {f_filing}) f
    WHERE n <= CASE form WHEN '10-Q' THEN 8 WHEN '10-K' THEN 3 ELSE 6 END""")
def latest_filings(spark, folder):
    filings = table(spark, folder, "f_filing")
    return FL.latest_of_forms(filings, {"10-Q": 8, "10-K": 3, "8-K": 6}).select(
        "ticker", "accession", "form", F.col("filing_date").cast("string").alias("filing_date"),
        F.col("filing_no").cast("long").alias("filing_no"),
    )


def _figure(record, name):
    return F.try_element_at(F.col(record)["financials"], F.lit(name)).cast("double")


@query("WITH " + RECORDS_SQL + """
    SELECT ticker, accession, filing_no, quarter, fiscal_year, date, period_end, revenue_bn, eps, net_income_bn,
           'SEC 10-Q' AS source, CASE WHEN net_income_bn IS NULL THEN 'eps_reported,revenue_bn'
                                 ELSE 'eps_reported,net_income_bn,revenue_bn' END AS keys
    FROM records WHERE form = '10-Q'""")
def quarter_records(spark, folder):
    made = FL.quarter_records(table(spark, folder, "f_filing"), table(spark, folder, "f_fact"))
    return made.select(
        "ticker", "accession", F.col("filing_no").cast("long").alias("filing_no"), "record.quarter",
        "record.fiscal_year", "record.date", "record.period_end", _figure("record", "revenue_bn").alias("revenue_bn"),
        _figure("record", "eps_reported").alias("eps"), _figure("record", "net_income_bn").alias("net_income_bn"),
        "record.source", F.array_join(F.array_sort(F.map_keys("record.financials")), ",").alias("keys"),
    )


@query("WITH " + RECORDS_SQL + """
    SELECT ticker, accession, filing_no, form, date AS filing_date, period_end, revenue_bn, eps, net_income_bn
    FROM records WHERE form = '10-K'""")
def annual_records(spark, folder):
    made = FL.annual_records(table(spark, folder, "f_filing"), table(spark, folder, "f_fact"))
    return made.select(
        "ticker", "accession", F.col("filing_no").cast("long").alias("filing_no"), "record.form",
        "record.filing_date", "record.period_end", _figure("record", "revenue_bn").alias("revenue_bn"),
        _figure("record", "eps_diluted").alias("eps"), _figure("record", "net_income_bn").alias("net_income_bn"),
    )


@query("WITH " + NEWS_SQL + """
    SELECT c.accession, coalesce(d.codes, '') AS codes, coalesce(whats, '') AS descriptions
    FROM code_list c LEFT JOIN described d USING (accession)""")
def item_descriptions(spark, folder):
    events = read_filings(table(spark, folder, "f_filing"), "8-K")
    codes = FL.item_codes(F.col("items"))
    return events.select("accession", codes.alias("codes")).select(
        "accession", F.array_join("codes", "|").alias("codes"),
        F.array_join(FL.describe_codes(F.col("codes")), ", ").alias("descriptions"),
    )


@query("WITH " + NEWS_SQL + """
    SELECT ticker, accession, filing_no, date, source, headline, snippet, tags FROM event_news""")
def filing_news(spark, folder):
    news = FL.news_from_filings(table(spark, folder, "f_filing"), table(spark, folder, "f_company"))
    return news.withColumn("tags", F.array_join("tags", "|")).withColumn("filing_no", F.col("filing_no").cast("long"))
