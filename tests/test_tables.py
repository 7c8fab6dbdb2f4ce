"""Catalog, quarters, filings and calls on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterdeck import schemas as S
from quarterdeck.functions import quarters as Q
from quarterdeck.operators import calls as CA
from quarterdeck.operators import catalog as C
from quarterdeck.operators import filings as FL
from quarterdeck.operators import quarters as QT
from quarterdeck.sources import tables as ST


def registry(spark):
    rows = [(0, "Alpha", "AAA", "aaa.json"), (1, "beta", "BBB", "bbb.json"), (2, "AAA", "CCC", "ccc.json"),
            (3, "Gone", "GGG", "ggg.json")]
    return spark.createDataFrame(rows, "pos int, name string, ticker string, file string")


def quarter(name, date=None, **more):
    return {"quarter": name, "date": date, **more}


def documents(spark):
    rows = [
        {"company": "Alpha Inc", "ticker": "AAA", "sector": "S", "transcripts": [
            quarter("Q1 2024", "2024-02-01"), quarter("Q2 2024", "2024-05-01"), quarter("Q4 2024", "2025-02-01")],
         "news": [{"headline": "h1", "tags": ["a", "b"]}, {"headline": "h2", "tags": []}]},
        {"company": "Beta", "ticker": "BBB", "transcripts": [quarter("Q2 2024", None), quarter("Q1 2024", "2024-01-01")]},
        {"company": "Gamma", "ticker": "CCC", "sector": "T", "transcripts": []},
        {"company": "Stray", "ticker": "DDD", "sector": "T"},
    ]
    return spark.createDataFrame(rows, S.COMPANY_DOC).withColumn("file", F.concat(F.lower("ticker"), F.lit(".json")))


def test_lookup_takes_the_first_entry_in_any_case(spark):
    reg = registry(spark)
    assert C.lookup(reg, "aaa").first().ticker == "AAA"        # a ticker of one, the name of a later one
    assert C.lookup(reg, "BETA").first().ticker == "BBB"
    assert C.lookup(reg, "nobody").isEmpty()
    keys = spark.createDataFrame([("aAa",), ("Beta",), ("nobody",), ("ccc",)], "key string")
    found = {r.key: (r.ticker, r.found) for r in C.lookup_batch(reg, keys).collect()}
    assert found == {"aAa": ("AAA", True), "Beta": ("BBB", True), "nobody": (None, False), "ccc": ("CCC", True)}


def test_unknown_company_is_an_error_with_the_names(spark):
    with pytest.raises(C.CompanyNotFound, match="nobody") as error:
        C.require_company(registry(spark), documents(spark), "nobody")
    assert [r.name for r in error.value.available.collect()] == ["Alpha", "beta", "AAA", "Gone"]
    assert C.require_company(registry(spark), documents(spark), "alpha").first().company == "Alpha Inc"


def test_company_detail(spark):
    rows = [tuple(r) for r in C.company_detail(registry(spark), documents(spark)).orderBy("pos").collect()]
    assert rows == [(0, "Alpha Inc", "AAA", "S", 3, 2), (1, "Beta", "BBB", "", 2, 0), (2, "Gamma", "CCC", "T", 0, 0)]
    assert [r.ticker for r in C.unregistered(registry(spark), documents(spark)).collect()] == ["DDD"]


def test_news_and_tags_in_order(spark):
    news = C.news_of(documents(spark))
    assert [(r.ticker, r.pos, r.headline) for r in news.orderBy("ticker", "pos").collect()] == [
        ("AAA", 0, "h1"), ("AAA", 1, "h2")]
    assert [(r.pos, r.tag_pos, r.tag) for r in QT.tags_of(news).collect()] == [(0, 0, "a"), (0, 1, "b")]


def test_latest_by_position_and_by_date(spark):
    quarters = C.quarters_of(documents(spark))
    def named(by):
        return {(r.ticker, r["rank"]): r.quarter for r in QT.latest_quarters(quarters, 2, by).collect()}
    assert named("position") == {("AAA", 1): "Q4 2024", ("AAA", 2): "Q2 2024", ("BBB", 1): "Q1 2024", ("BBB", 2): "Q2 2024"}
    assert named("date") == named("position") # the undated quarter of BBB comes last
    pairs = {r.ticker: (r.current.quarter, r.previous.quarter) for r in QT.pair_latest(quarters, "position").collect()}
    assert pairs == {"AAA": ("Q4 2024", "Q2 2024"), "BBB": ("Q1 2024", "Q2 2024")}
    alone = quarters.filter("pos = 0")
    assert all(r.previous is None for r in QT.pair_latest(alone).collect())
    with pytest.raises(ValueError):
        QT.latest_quarters(quarters, 2, "size")


def test_latest_records_inside_a_document(spark):
    docs = documents(spark)
    for by in ("position", "date"):
        nested = {r.ticker: [q.quarter for q in r.two] for r in docs.select(
            "ticker", QT.latest_records(F.col("transcripts"), 2, by).alias("two")).collect() if r.two}
        flat = {}
        for r in QT.latest_quarters(C.quarters_of(docs), 2, by).orderBy("rank").collect():
            flat.setdefault(r.ticker, []).append(r.quarter)
        assert nested == flat


def test_gaps_to_the_record_before(spark):
    rows = QT.previous_quarters(C.quarters_of(documents(spark))).orderBy("ticker", "pos").collect()
    assert [(r.ticker, r.quarter, r.previous_quarter, r.gap_quarters) for r in rows] == [
        ("AAA", "Q1 2024", None, None), ("AAA", "Q2 2024", "Q1 2024", 0), ("AAA", "Q4 2024", "Q2 2024", 1),
        ("BBB", "Q2 2024", None, None), ("BBB", "Q1 2024", "Q2 2024", 0)]


def test_newest_first_of_a_list(spark):
    rows = spark.sql("SELECT array(1, 2, 3) a UNION ALL SELECT array(1) UNION ALL SELECT cast(array() AS array<int>)")
    assert [r.o for r in rows.select(QT.newest_first(F.col("a"), 2).alias("o")).collect()] == [[3, 2], [1], []]


def test_upsert(spark):
    old = registry(spark).select(
        F.col("pos").cast("long"), "name", "ticker", "file", F.lit("note").alias("fiscal_year_note"),
        F.array(F.lit("Q1")).alias("transcripts"), F.lit(1).cast("long").alias("transcript_count"),
        F.lit(2).cast("long").alias("news_items"), F.lit("soon").alias("next_earnings"),
        F.array(F.lit("theme")).alias("primary_themes"))
    updates = spark.createDataFrame(
        [("BBB", "Beta New", 8, 6, 1), ("ZZZ", "Zed", 1, 1, 2), ("ZZZ", "Zed Two", 3, 4, 4), ("YYY", "Why", 5, 5, 3)],
        "ticker string, name string, transcript_count long, news_items long, update_no int")
    rows = C.upsert_registry(old, updates).orderBy("appended", "pos").collect()
    assert [(r.ticker, r.name, r.transcript_count, r.news_items) for r in rows] == [
        ("AAA", "Alpha", 1, 2), ("BBB", "Beta New", 8, 6), ("CCC", "AAA", 1, 2), ("GGG", "Gone", 1, 2),
        ("ZZZ", "Zed Two", 3, 4), ("YYY", "Why", 5, 5)]
    beta, zed = rows[1], rows[4]
    assert (beta.fiscal_year_note, beta.transcripts, beta.primary_themes, beta.next_earnings) == (
        "note", ["Q1"], ["theme"], "soon")
    assert (zed.file, zed.fiscal_year_note, zed.transcripts, zed.primary_themes, zed.next_earnings) == (
        "zzz.json", "", [], [], None)


def test_metrics(spark):
    doc = spark.createDataFrame([("A", 0, {"n": "122", "f": "true", "t": "all-time", "z": None, "x": "7.8"})],
                                "ticker string, pos int, financials map<string,string>")
    rows = {r.name: (r.num, r.flag, r.text) for r in QT.metrics_long(doc).collect()}
    assert rows == {"n": (122.0, None, None), "f": (None, True, None), "t": (None, None, "all-time"),
                    "z": (None, None, None), "x": (7.8, None, None)}


def test_grid_labels_and_report_months(spark):
    tickers = spark.createDataFrame([("NVDA",), ("AAPL",), ("XYZ",)], "ticker string")
    rows = QT.quarter_grid(tickers, F.lit("2025-02-10").cast("date"), 3).collect()
    by = {(r.ticker, r.grid_no): (r.label, r.report_year, r.report_month) for r in rows}
    assert by[("XYZ", 0)] == ("Q4 2024", 2025, 1) and by[("XYZ", 1)] == ("Q3 2024", 2024, 10)
    assert by[("NVDA", 0)] == ("Q4 FY2025", 2025, 1) and by[("AAPL", 2)] == ("Q2 FY2024", 2024, 7)
    assert len(rows) == 9


def test_filing_quarter(spark):
    rows = spark.createDataFrame([("2024-12-28", "2025-01-31"), (None, "2025-01-31"), ("", "2025-01-31")],
                                 "p string, d string")
    ours = [tuple(r.o) for r in rows.select(Q.filing_quarter(F.col("p"), F.col("d")).alias("o")).collect()]
    assert ours == [("Q4 2024", "2024"), ("Filing 2025-01-31", ""), ("Filing 2025-01-31", "")]


def fact(ord, label, val, abstract=False, dim=None, period="2024-12-28", pos=0, accession="f"):
    return (accession, ord, label, abstract, dim, period, pos, val)


def classify_model(rows):
    """The chain of tests, row by row."""
    found = {"revenue": None, "net_income": None, "eps": None}
    periods = [(r[6], r[5]) for r in rows if r[5][:1].isdigit()]
    if not periods:
        return None
    first = min(periods)[1]
    for _, _, label, abstract, dim, period, _, val in sorted(rows, key=lambda r: r[1]):
        if period != first or abstract or dim not in (None, "nan") or val is None or val != val:
            continue
        label = label.lower()
        if any(w in label for w in ("net sales", "revenue")) and found["revenue"] is None:
            found["revenue"] = val
        elif label.strip() in ("net income", "net income:"):
            found["net_income"] = val
        elif all(w in label for w in ("diluted", "per share", "dollar")):
            found["eps"] = val
    return found["revenue"], found["net_income"], found["eps"]


def test_classified_facts_follow_the_chain(spark):
    import random
    rng = random.Random(11)
    labels = ["Cost of revenue", "Net sales", " Net Income ", "net income:", "Net income (loss)",
              "Revenue per share, diluted, dollars", "Diluted EPS, dollars per share", "Gross margin"]
    filings = {}
    for i in range(300):
        filings[f"f{i}"] = [
            fact(o, rng.choice(labels), rng.choice([None, float("nan"), 0.0, 1.5, 2.5e9, 3.25]),
                 rng.random() < 0.1, rng.choice([None, None, "nan", "Segment"]), *rng.choice([
                     ("2024-12-28", 1), ("2024-12-28", 1), ("2023-12-28", 2), ("units", 0)]), f"f{i}")
            for o in range(rng.randint(1, 12))]
    rows = spark.createDataFrame([r for rs in filings.values() for r in rs], S.FACT)
    ours = {r.accession: (r.revenue, r.net_income, r.eps_diluted) for r in FL.classify_facts(rows).collect()}
    model = {k: classify_model(v) for k, v in filings.items()}
    assert ours == {k: v for k, v in model.items() if v is not None}


def test_records_of_filings(spark):
    filings = spark.createDataFrame([
        ("A", "1", "10-Q", dt.date(2024, 5, 1), dt.date(2024, 3, 31), None),
        ("A", "2", "10-Q", dt.date(2024, 8, 1), dt.date(2024, 6, 30), None),
        ("A", "3", "10-Q", dt.date(2024, 11, 1), None, None),
        ("A", "4", "10-K", dt.date(2024, 11, 1), dt.date(2024, 9, 28), None),
        ("A", "5", "8-K", dt.date(2024, 11, 2), None, "5.07, 9.01,,6.99 "),
        ("A", "6", "8-K", dt.date(2024, 11, 2), None, None),
    ], "ticker string, accession string, form string, filing_date date, period_of_report date, items string")
    facts = spark.createDataFrame(
        [fact(0, "Revenue", 124.3e9, accession="2"), fact(1, "Net income", 0.0, accession="2"),
         fact(0, "Net sales", 391.04e9, accession="4"), fact(1, "Net income", 93.74e9, accession="4")], S.FACT)
    quarters = FL.quarter_records(filings, facts, 2).orderBy("filing_no").collect()
    assert [(r.record.quarter, r.record.financials) for r in quarters] == [
        ("Filing 2024-11-01", {"revenue_bn": None, "eps_reported": None}),
        ("Q2 2024", {"revenue_bn": "124.3", "eps_reported": None})]
    assert quarters[0].record.speakers == [] and quarters[0].record.tone == "" and quarters[0].record.source == "SEC 10-Q"
    annual = FL.annual_records(filings, facts).first().record
    assert (annual.period_end, annual.financials) == ("2024-09-28", {"revenue_bn": "391.0", "net_income_bn": "93.7"})
    names = spark.createDataFrame([("A", "Acme")], "ticker string, company string")
    news = FL.news_from_filings(filings, names).orderBy("filing_no").collect()
    assert [(n.headline, n.snippet, n.tags) for n in news] == [
        ("Acme: SEC Filing (8-K)", "8-K filed on 2024-11-02. Items: N/A.", ["8-K", "SEC Filing"]),
        ("Acme: Submission of Matters to a Vote of Security Holders, Financial Statements and Exhibits, Item 6.99",
         "8-K filed on 2024-11-02. Items: 5.07, 9.01,,6.99 .", ["5.07", "9.01", "6.99", "8-K", "SEC Filing"])]
    lists = FL.document_lists(names, filings, facts, 2).first()
    assert [q.quarter for q in lists.transcripts] == ["Q2 2024", "Filing 2024-11-01"]
    assert [n.headline for n in lists.news] == [n.headline for n in news] and len(lists.annual_filings) == 1


def test_wide_facts(spark):
    wide = spark.createDataFrame([("f", 0, "Revenue", False, None, "USD", 5.0, 4.0)],
                                 "accession string, ord int, label string, abstract boolean, dim string, unit string, "
                                 "`2024-12-28` double, `2023-12-30` double")
    assert [(r.period, r.val) for r in ST.read_facts(wide).orderBy("period_pos").collect()] == [
        ("2024-12-28", 5.0), ("2023-12-30", 4.0)]
    assert [(r.period, r.val) for r in ST.first_period(wide).collect()] == [("2024-12-28", 5.0)]


def test_events_are_cut_before_missing_texts_drop_out(spark):
    events = spark.createDataFrame([("A", "Acme", 2024, q, n, None) for n, q in enumerate((4, 3, 2, 1))],
                                   "ticker string, company string, year int, quarter int, event_no int, conference_date date")
    texts = spark.createDataFrame([("A", 2024, 4, "text"), ("A", 2024, 3, ""), ("A", 2024, 1, "late")],
                                  "ticker string, year int, quarter int, full_text string")
    kept = ST.read_transcript_events(events, texts, 3)
    assert [r.quarter for r in kept.collect()] == [4]
    raw = CA.raw_transcripts(ST.read_transcript_events(events, texts, 4)).orderBy("event_no").collect()
    assert [(r.quarter_label, r.conference_date, r.transcript_length) for r in raw] == [
        ("Q4 2024", "", 4), ("Q1 2024", "", 4)]
    index = CA.transcript_index(CA.raw_transcripts(ST.read_transcript_events(events, texts, 4))).first()
    assert index.total_transcripts == 2 and [t.file for t in index.transcripts] == ["Q4_2024.json", "Q1_2024.json"]


def test_company_info(spark):
    tickers = spark.createDataFrame([(t,) for t in "ABCD"], "ticker string")
    info = spark.createDataFrame([("A", "Long", "Short", "S", "I"), ("B", "", "Short", None, "I"), ("C", None, None, "S", None)],
                                 "ticker string, longName string, shortName string, sector string, industry string")
    rows = {r.ticker: tuple(r)[1:] for r in ST.company_info(tickers, info).collect()}
    assert rows == {"A": ("Long", "S", "I"), "B": ("Short", "Unknown", "I"), "C": ("C", "S", "Unknown"),
                    "D": ("D", "Unknown", "Unknown")}
