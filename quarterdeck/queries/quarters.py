"""Queries on the quarters of a company and on the calendar grid."""

from pyspark.sql import functions as F

from quarterdeck.functions import quarters as Q
from quarterdeck.functions import text as X
from quarterdeck.operators import quarters as QT
from quarterdeck.queries.catalog import RECORDS_SQL, as_of, documents
from quarterdeck.queries.registry import query
from quarterdeck.queries.views import table


def rich_quarters(spark, folder):
    """Order quarters with lists and open-keyed figures, as a curated document has them."""
    quarter = table(spark, folder, "f_quarter")
    return quarter.select(
        "ticker", "company", "pos", "quarter", "date", "n_lines", "revenue",
        F.array(F.concat("company", F.lit(" (CEO)")), F.concat("sector", F.lit(" Desk (CFO)"))).alias("speakers"),
        F.create_map(
            F.lit("lines"), F.col("n_lines").cast("string"),
            F.lit("revenue_bn"), F.when(F.col("n_lines") > 1, X.float_text(F.col("revenue"))),
            F.lit("missed"), (F.col("n_lines") > 4).cast("string"),
            F.lit("note"), F.concat(F.lit("“"), "sector", F.lit('" mix')),
        ).alias("financials"),
        F.when(F.col("n_lines") > 2, F.array(
            F.struct(F.col("company").alias("speaker"), F.lit("Lines").alias("theme"),
                     F.concat(F.col("n_lines").cast("string"), F.lit(" lines")).alias("text")),
            F.struct(F.col("company").alias("speaker"), F.lit("Trade").alias("theme"), F.col("sector").alias("text")),
        )).otherwise(F.array()).alias("key_quotes"),
        F.array(F.col("sector"), F.concat(F.lit("Quarter "), "quarter")).alias("key_themes"),
        F.when(F.col("n_lines") > 3, F.array(F.lit("Many lines"))).otherwise(F.array()).alias("risks"),
        F.when(F.col("n_lines") > 1, F.lit("firm")).alias("tone"),
    )


@query("""
    SELECT ticker, pos, 'lines' AS name, n_lines::double AS num, NULL::string AS flag, NULL::string AS text
      FROM {f_quarter}
    UNION ALL SELECT ticker, pos, 'revenue_bn', CASE WHEN n_lines > 1 THEN revenue END, NULL, NULL
      FROM {f_quarter}
    UNION ALL SELECT ticker, pos, 'missed', NULL, cast(n_lines > 4 AS string), NULL FROM {f_quarter}
    UNION ALL SELECT ticker, pos, 'note', NULL, NULL, '“' || sector || '" mix' FROM {f_quarter}""")
def metrics_long(spark, folder):
    long = QT.metrics_long(rich_quarters(spark, folder))
    return long.withColumn("flag", F.col("flag").cast("string"))


@query("""
    SELECT ticker, pos, quarter, 0::bigint AS item_pos, company AS speaker, 'Lines' AS theme, n_lines || ' lines' AS text
      FROM {f_quarter} WHERE n_lines > 2
    UNION ALL SELECT ticker, pos, quarter, 1, company, 'Trade', sector FROM {f_quarter} WHERE n_lines > 2""")
def quotes_flat(spark, folder):
    return QT.quotes_of(rich_quarters(spark, folder)).withColumn("item_pos", F.col("item_pos").cast("long"))


@query("""
    SELECT ticker, pos, quarter, 0::bigint AS item_pos, sector AS theme FROM {f_quarter}
    UNION ALL SELECT ticker, pos, quarter, 1, 'Quarter ' || quarter FROM {f_quarter}""")
def themes_flat(spark, folder):
    return QT.themes_of(rich_quarters(spark, folder)).withColumn("item_pos", F.col("item_pos").cast("long"))


@query("""
    SELECT ticker, pos, quarter, 0::bigint AS item_pos, 'Many lines' AS risk FROM {f_quarter} WHERE n_lines > 3""")
def risks_flat(spark, folder):
    return QT.risks_of(rich_quarters(spark, folder)).withColumn("item_pos", F.col("item_pos").cast("long"))


@query("""
    SELECT ticker, pos, quarter, 0::bigint AS item_pos, company || ' (CEO)' AS speaker FROM {f_quarter}
    UNION ALL SELECT ticker, pos, quarter, 1, sector || ' Desk (CFO)' FROM {f_quarter}""")
def speakers_flat(spark, folder):
    return QT.speakers_of(rich_quarters(spark, folder)).withColumn("item_pos", F.col("item_pos").cast("long"))


LATEST = """
    SELECT * FROM (SELECT ticker, quarter, date, revenue,
        row_number() OVER (PARTITION BY ticker ORDER BY {order}) AS rank FROM {{f_quarter}}) r WHERE rank <= 2"""


def _latest(spark, folder, by):
    latest = QT.latest_quarters(table(spark, folder, "f_quarter"), 2, by)
    return latest.select("ticker", "quarter", "date", "revenue",
                         F.col("rank").cast("long").alias("rank"))


@query(LATEST.format(order="pos DESC"))
def latest_by_position(spark, folder):
    return _latest(spark, folder, "position")


@query(LATEST.format(order="date DESC, pos DESC"))
def latest_by_date(spark, folder):
    return _latest(spark, folder, "date")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, pos DESC) AS n FROM {f_quarter})
    SELECT c.ticker, c.company, c.quarter, c.revenue, p.quarter AS previous_quarter,
           p.revenue AS previous_revenue, c.revenue / p.revenue - 1 AS growth
    FROM r c LEFT JOIN r p ON p.ticker = c.ticker AND p.n = 2 WHERE c.n = 1""")
def quarter_pairs(spark, folder):
    """The latest quarter of every company against the one before."""
    quarters = table(spark, folder, "f_quarter").select(
        "ticker", "company", "pos", "quarter", "date", "revenue"
    )
    pairs = QT.pair_latest(quarters, by="date")
    return pairs.select(
        "ticker", "current.company", "current.quarter", "current.revenue",
        F.col("previous.quarter").alias("previous_quarter"), F.col("previous.revenue").alias("previous_revenue"),
        (F.col("current.revenue") / F.col("previous.revenue") - 1).alias("growth"),
    )


@query("""
    WITH n AS (SELECT *, cast(right(quarter, 4) AS bigint) * 4 + cast(substr(quarter, 2, 1) AS bigint) AS no
               FROM {f_quarter})
    SELECT ticker, pos, quarter, previous_quarter, coalesce(gap_quarters::string, 'none') AS gap_quarters
    FROM (SELECT ticker, pos, quarter, lag(quarter) OVER w AS previous_quarter, abs(no - lag(no) OVER w) - 1 AS gap_quarters
          FROM n WINDOW w AS (PARTITION BY ticker ORDER BY pos)) x""")
def quarter_gaps(spark, folder):
    gaps = QT.previous_quarters(table(spark, folder, "f_quarter"))
    return gaps.select("ticker", "pos", "quarter", "previous_quarter",
                       F.coalesce(F.col("gap_quarters").cast("string"), F.lit("none")).alias("gap_quarters"))


@query("WITH " + RECORDS_SQL + """
    SELECT c.ticker, coalesce(names, '') AS newest FROM {f_company} c LEFT JOIN (
        SELECT ticker, string_agg(quarter, '; ' ORDER BY filing_no) AS names FROM records
        WHERE form = '10-Q' AND filing_no <= 2 GROUP BY ticker) r ON r.ticker = c.ticker""")
def newest_first(spark, folder):
    newest = QT.newest_first(F.col("transcripts"), 2)
    return documents(spark, folder, figures=False).select(
        "ticker", F.array_join(F.transform(newest, lambda r: r["quarter"]), "; ").alias("newest")
    )


FISCAL_TICKER = """
    CASE pos % 9 WHEN 0 THEN 'NVDA' WHEN 1 THEN 'AAPL' WHEN 2 THEN 'WMT' WHEN 3 THEN 'MSFT' WHEN 4 THEN 'ORCL'
    ELSE ticker END"""
FISCAL_END = "CASE WHEN pos % 9 IN (0, 2) THEN 1 WHEN pos % 9 < 5 THEN 0 END"


@query(f"""
    SELECT pos, {FISCAL_TICKER} AS ticker, i AS grid_no, year(d)::bigint AS year, quarter(d)::bigint AS q,
           'Q' || quarter(d) || CASE WHEN ends IS NULL THEN ' ' || year(d) ELSE ' FY' || (year(d) + ends) END AS label,
           year(d + INTERVAL 3 MONTH)::bigint AS report_year, month(d + INTERVAL 3 MONTH)::bigint AS report_month
    FROM (SELECT *, {FISCAL_END} AS ends, DATE '2002-01-01' - INTERVAL 3 MONTH * (i + 1) AS d
          FROM {{f_company}}, (SELECT unnest(range(8)) AS i)) x""")
def quarter_grid(spark, folder):
    company = table(spark, folder, "f_company").select("pos", F.expr(FISCAL_TICKER).alias("ticker"))
    grid = QT.quarter_grid(company, as_of(), 8)
    return grid.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in grid.dtypes])


@query("""
    SELECT accession, quarter, prev, month(s + INTERVAL 3 MONTH)::bigint AS report_month FROM (
        SELECT accession, s, 'Q' || quarter(s) || ' ' || year(s) AS quarter,
            CASE WHEN quarter(s) = 1 THEN 'Q4 ' || (year(s) - 1) ELSE 'Q' || (quarter(s) - 1) || ' ' || year(s) END AS prev
        FROM (SELECT accession, date_trunc('quarter', filing_date) AS s FROM {f_filing}) a) b""")
def calendar_quarters(spark, folder):
    """The quarter of each filing date, the quarter before it, and the month that reports it."""
    filings = table(spark, folder, "f_filing")
    start = Q.quarter_start(F.year("filing_date"), F.quarter("filing_date"))
    before = Q.previous_quarter_start(start)

    def label(day):
        return Q.quarter_label(F.lit(""), F.year(day), F.quarter(day))

    return filings.select("accession", label(start).alias("quarter"), label(before).alias("prev"),
                          F.month(Q.report_month_start(start)).cast("long").alias("report_month"))


@query("""
    SELECT accession, coalesce('Q' || quarter(period_of_report) || ' ' || year(period_of_report),
                               'Filing ' || cast(filing_date AS string)) AS quarter,
           coalesce(cast(year(period_of_report) AS string), '') AS fiscal_year
    FROM {f_filing}""")
def filing_quarters(spark, folder):
    named = Q.filing_quarter(F.col("period_of_report"), F.col("filing_date"))
    return table(spark, folder, "f_filing").select("accession", named.alias("n")).select("accession", "n.*")
