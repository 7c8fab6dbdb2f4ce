"""Quarters of a company: latest, previous, nested lists, figures, the calendar grid."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import quarters as Q
from quarterdeck.functions import replies as R


def _order(by: str) -> list[Column]:
    if by == "position":
        return [F.col("pos").desc()]
    if by == "date":
        return [F.col("date").desc_nulls_last(), F.col("pos").desc()]
    raise ValueError("by is 'position' or 'date'")


def latest_quarters(quarters: DataFrame, n: int = 2, by: str = "date") -> DataFrame:
    """Last n quarters of each company, ``rank`` 1 being the latest.

    ``by="position"`` takes the end of the list as it stands, which in a
    newest-first document is the oldest quarter; ``by="date"`` looks at the
    dates. Each task keeps n rows per company before the shuffle.
    """
    newest_first = Window.partitionBy("ticker").orderBy(*_order(by))
    return quarters.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= n)


def newest_first(records: Column, n: int) -> Column:
    """Last n elements of a list, latest first."""
    return F.reverse(F.slice(records, -F.greatest(F.lit(1), F.least(F.lit(n), F.size(records))), n))


def latest_records(records: Column, n: int, by: str = "date") -> Column:
    """As ``latest_quarters``, for the list inside a document; nothing is shuffled."""
    if by == "position":
        return newest_first(records, n)
    day, pos = (lambda r: r["r"]["date"]), (lambda r: r["pos"])
    placed = F.transform(records, lambda r, i: F.struct(i.alias("pos"), r.alias("r")))

    def order(a, b):
        later = F.coalesce(day(a), F.lit("")) > F.coalesce(day(b), F.lit(""))
        same = F.coalesce(day(a), F.lit("")) == F.coalesce(day(b), F.lit(""))
        return F.when(later | (same & (pos(a) > pos(b))), -1).otherwise(1)

    return F.transform(F.slice(F.array_sort(placed, order), 1, n), lambda p: p["r"])


def pair_latest(quarters: DataFrame, by: str = "date") -> DataFrame:
    """The latest quarter of each company and the one before it (null when alone).

    The second window runs over the two rows that are left, in the same
    partitions and order, so it adds neither a shuffle nor a sort.
    """
    record = F.struct(*[F.col(c) for c in quarters.columns])
    order = Window.partitionBy("ticker").orderBy(*_order(by))
    two = latest_quarters(quarters, 2, by).select("*", record.alias("current"))
    paired = two.withColumn("previous", F.lead("current").over(order)).filter(F.col("rank") == 1)
    return paired.select("ticker", "current", "previous")


def previous_quarters(quarters: DataFrame) -> DataFrame:
    """Every quarter with the record before it in the list, and the calendar gap between them.

    Positions are dense, so "before" is an equality on (ticker, pos) and a
    company with very many quarters is spread over all tasks; a window by ticker
    would sort them in one. ``gap_quarters`` counts the quarters left out.
    """
    index = F.col("label.year") * 4 + F.col("label.q")
    now = quarters.withColumn("label", Q.parse_label(F.col("quarter"))).withColumn("quarter_no", index)
    now = now.drop("label")
    before = now.select(
        "ticker",
        (F.col("pos") + 1).alias("pos"),
        F.col("quarter").alias("previous_quarter"),
        F.col("quarter_no").alias("_no"),
    )
    gap = F.abs(F.col("quarter_no") - F.col("_no")) - 1
    return now.join(before, ["ticker", "pos"], "left").withColumn("gap_quarters", gap).drop("quarter_no", "_no")


def _listed(quarters: DataFrame, column: str) -> DataFrame:
    return quarters.select("ticker", "pos", "quarter", F.posexplode(column).alias("item_pos", "item"))


def quotes_of(quarters: DataFrame) -> DataFrame:
    return _listed(quarters, "key_quotes").select("ticker", "pos", "quarter", "item_pos", "item.*")


def themes_of(quarters: DataFrame) -> DataFrame:
    return _listed(quarters, "key_themes").withColumnRenamed("item", "theme")


def risks_of(quarters: DataFrame) -> DataFrame:
    return _listed(quarters, "risks").withColumnRenamed("item", "risk")


def speakers_of(quarters: DataFrame) -> DataFrame:
    return _listed(quarters, "speakers").withColumnRenamed("item", "speaker")


def tags_of(news: DataFrame) -> DataFrame:
    return news.select("ticker", "pos", F.posexplode("tags").alias("tag_pos", "tag"))


def metrics_long(quarters: DataFrame) -> DataFrame:
    """Open-keyed figures, one row each, as number, flag or text (all null for a null)."""
    value = F.col("value")
    return quarters.select("ticker", "pos", F.explode("financials").alias("name", "value")).select(
        "ticker", "pos", "name",
        R.metric_number(value).alias("num"), R.metric_flag(value).alias("flag"), R.metric_text(value).alias("text"),
    )


def quarter_grid(companies: DataFrame, as_of: Column, n: int = V.QUARTERS) -> DataFrame:
    """The last n finished calendar quarters of every company, newest first.

    Made per row by exploding a short sequence; there is no join.
    """
    starts = Q.completed_quarters(as_of, n)
    grid = companies.select("*", F.posexplode(starts).alias("grid_no", "start"))
    year, q = F.year("start"), F.quarter("start")
    report = Q.report_month_start(F.col("start"))
    return grid.select(
        *companies.columns, "grid_no", year.alias("year"), q.alias("q"),
        Q.quarter_label(F.col("ticker"), year, q).alias("label"),
        F.year(report).alias("report_year"), F.month(report).alias("report_month"),
    )
