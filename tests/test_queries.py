"""Every registered query against its SQL counterpart, and the shape of the plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarterdeck.operators import filings as FL
from quarterdeck.operators import pages as P
from quarterdeck.operators import quarters as QT
from quarterdeck.queries.registry import ORACLES, QUERIES
from quarterdeck.queries.views import TABLES, table
from tools.check_oracles import rows

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    assert len(ours) > 0
    if name in WITHOUT_SQL:
        assert name not in ORACLES
        return
    theirs = con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_limits_are_reached(spark):
    """Groups of the derived tables are larger than the sizes that queries cut at."""
    hits = table(spark, FOLDER, "f_hit").groupBy("ticker", "q", "query_no").count()
    assert hits.agg(F.max("count")).first()[0] > 8
    assert table(spark, FOLDER, "f_call").groupBy("ticker").count().agg(F.max("count")).first()[0] > 8
    assert table(spark, FOLDER, "f_hit").agg(F.max(F.length("body"))).first()[0] > 4000


def test_filings_come_before_facts(spark):
    """Facts of filings that are not shown go before they are grouped."""
    made = plan(FL.quarter_records(table(spark, FOLDER, "f_filing"), table(spark, FOLDER, "f_fact"), 2))
    assert made.index("HashAggregate") < made.index("LeftSemi")  # plans are printed from the result down


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_pair_no_rows_and_use_python_only_where_they_must(spark):
    plans = {name: plan(build(spark, FOLDER)) for name, build in QUERIES.items()}
    assert not [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoop" in p]
    users = {n for n, p in plans.items() if re.search("InPandas|ArrowEvalPython|BatchEvalPython", p)}
    assert users == {"completed", "run_stats"}  # the others read replies that are settled


def test_limits_are_taken_before_the_shuffle(spark):
    latest = plan(FL.latest_filings(table(spark, FOLDER, "f_filing"), "10-Q", 8))
    assert latest.count("WindowGroupLimit") == 2 and latest.rindex("WindowGroupLimit") > latest.index("Exchange")
    pairs = plan(QT.pair_latest(table(spark, FOLDER, "f_quarter").select("ticker", "pos", "quarter", "date")))
    assert pairs.count("WindowGroupLimit") == 2


def test_conditions_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "filing")
    table(spark, FOLDER, "f_filing").write.parquet(path)
    scan = plan(FL.latest_filings(spark.read.parquet(path), "10-K", 3).select("ticker", "accession"))
    assert "EqualTo(form,10-K)" in scan and "items" not in re.search(r"ReadSchema: (\S+)", scan)[1]


def test_a_third_of_all_rows_in_one_group(spark):
    """Hot companies, filings, queries: results stay whole and only a few rows per group are shuffled."""
    n = 30000
    hot = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string")))
    rows_in = spark.range(0, n, 1, 8).select("id", hot.alias("ticker"))
    filings = rows_in.select("ticker", F.lpad(F.col("id").cast("string"), 9, "0").alias("accession"), F.lit("10-Q").alias("form"),
                             F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 5000).cast("int")).alias("filing_date"))
    latest = FL.latest_filings(filings, "10-Q", 8)
    got = [r.accession for r in latest.filter("ticker = 'HOT'").orderBy("filing_no").collect()]
    expected = sorted(((i % 5000, f"{i:09d}") for i in range(0, n, 3)), reverse=True)[:8]
    assert got == [a for _, a in expected] and latest.count() == 8 + n - n // 3

    facts = rows_in.select(F.col("ticker").alias("accession"), F.col("id").alias("ord"), F.lit("Revenue").alias("label"),
                           F.lit(False).alias("abstract"), F.lit(None).cast("string").alias("dim"),
                           F.lit("2024").alias("period"), F.lit(0).alias("period_pos"), F.col("id").cast("double").alias("val"))
    classified = FL.classify_facts(facts)
    assert classified.filter("accession = 'HOT'").first().revenue == 0.0 and classified.count() == n - n // 3 + 1

    hits = rows_in.select("ticker", F.lit(2024).alias("year"), F.lit(1).alias("q"), F.lit(1).alias("query_no"),
                          (F.col("id") % 9 + 1).cast("int").alias("rank"), F.lit("https://fool.com/q1-2024").alias("href"),
                          F.col("id").cast("string").alias("title"))
    assert P.pick_page(hits).filter("ticker = 'HOT'").count() == 1

    listed = rows_in.filter("ticker = 'HOT'").select(
        "ticker", (F.col("id") / 3).cast("int").alias("pos"), F.lit("Q1 2024").alias("quarter"))
    gaps = QT.previous_quarters(listed)
    assert gaps.filter("previous_quarter IS NOT NULL").count() == n // 3 - 1
    assert "Window" not in plan(gaps)
