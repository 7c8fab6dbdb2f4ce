"""Filings: statement facts, latest filings, quarter and annual records, 8-K news."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck import schemas as S
from quarterdeck.functions import quarters as Q
from quarterdeck.functions import text as X
from quarterdeck.operators.catalog import quarter_record
from quarterdeck.operators.shared import ordered_list


def latest_filings(filings: DataFrame, form: str, n: int) -> DataFrame:
    """Newest n filings of a form per company; ``filing_no`` 1 is the newest."""
    return latest_of_forms(filings, {form: n})


def latest_of_forms(filings: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Newest filings of several forms per company, each form with its own number.

    One pass for all forms: each task keeps the largest of the numbers per
    company and form before the shuffle.
    """
    newest = Window.partitionBy("ticker", "form").orderBy(F.col("filing_date").desc(), F.col("accession").desc())
    ranked = filings.filter(F.col("form").isin(list(sizes))).withColumn("filing_no", F.row_number().over(newest))
    if len(sizes) == 1:
        return ranked.filter(F.col("filing_no") <= next(iter(sizes.values())))
    keep = F.lit(False)
    for form, n in sizes.items():
        keep = keep | ((F.col("form") == form) & (F.col("filing_no") <= n))
    return ranked.filter((F.col("filing_no") <= max(sizes.values())) & keep)


def classify_facts(facts: DataFrame) -> DataFrame:
    """Revenue, net income and diluted EPS of each filing, from its first period.

    One pass of aggregates that combine before the shuffle, so a filing of any
    size is never sorted in one task. The rows form a chain: a revenue-like row
    is the revenue unless that is known already, and only then may be tested for
    the other two. Hence a revenue-like EPS row counts unless it is the row that
    gave the revenue; when the last EPS row is that one, the last EPS row that
    is not revenue-like stands in (all other revenue-like rows come later).
    """
    label, val, row = F.lower("label"), F.col("val"), F.col("ord")

    def has(words):
        return [F.contains(label, F.lit(w)) for w in words]

    usable = (
        ~F.coalesce("abstract", F.lit(False))
        & (F.col("dim").isNull() | (F.col("dim") == "nan"))
        & val.isNotNull()
        & ~F.isnan(val)
    )
    revenue_like = reduce(or_, has(V.REVENUE_WORDS))
    net_income = X.strip(label).isin(V.NET_INCOME_LABELS)
    eps = reduce(and_, has(V.DILUTED_EPS_WORDS))

    rows = facts.filter(F.col("period").rlike("^[0-9]")).select(
        "accession", "period", "period_pos", val.alias("val"), row.alias("ord"),
        (usable & revenue_like).alias("is_revenue"),
        (usable & net_income & ~revenue_like).alias("is_net_income"),
        (usable & eps).alias("is_eps"),
        (usable & eps & ~revenue_like).alias("is_plain_eps"),
    )

    def when(flag):
        return F.when(F.col(flag), F.col("ord"))

    # numbers only in the aggregate buffers, so that they are hashed and not sorted
    per_period = rows.groupBy("accession", "period_pos", "period").agg(
        F.min_by("val", when("is_revenue")).alias("revenue"),
        F.max_by("val", when("is_net_income")).alias("net_income"),
        F.max_by("val", when("is_eps")).alias("any_eps"),
        F.max_by("val", when("is_plain_eps")).alias("plain_eps"),
        F.min(when("is_revenue")).alias("revenue_row"),
        F.max(when("is_eps")).alias("eps_row"),
    )
    found = F.struct(
        "period", "revenue", "net_income",
        F.when(F.col("eps_row") == F.col("revenue_row"), F.col("plain_eps"))
        .otherwise(F.col("any_eps")).alias("eps_diluted"),
    )
    first = per_period.groupBy("accession").agg(F.min_by(found, "period_pos").alias("found"))
    return first.select("accession", "found.*")


def facts_of(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """The facts of the given filings only, so that no others are shuffled and grouped."""
    return facts.join(filings.select("accession"), "accession", "left_semi")


def with_facts(filings: DataFrame, classified: DataFrame) -> DataFrame:
    """Filings with their facts; a filing without usable facts stays."""
    return filings.join(classified, "accession", "left")


def with_figures(filings: DataFrame, classified: DataFrame) -> DataFrame:
    """Filings with ``revenue_bn``, ``net_income_bn`` and ``eps``: billions with one decimal, zero as missing.

    The numbers are made in steps, so that no step repeats the work of another.
    """
    scaled = with_facts(filings, classified).select(
        *filings.columns, X.in_billions(F.col("revenue")).alias("_revenue"),
        X.in_billions(F.col("net_income")).alias("_net_income"),
        F.nullif("eps_diluted", F.lit(0.0)).alias("eps"),
    )
    return scaled.select(
        *filings.columns, X.round_to_tenth(F.col("_revenue")).alias("revenue_bn"),
        X.round_to_tenth(F.col("_net_income")).alias("net_income_bn"), "eps",
    )


def with_figure_texts(figured: DataFrame) -> DataFrame:
    """Adds the figures as texts, once each, for the maps below."""
    names = ("revenue_bn", "net_income_bn", "eps")
    return figured.select("*", *[X.float_text(F.col(n)).alias(f"{n}_text") for n in names])


def figures_map(always: list, if_known: list) -> Column:
    """A map of figures as text: ``always`` keeps nulls, ``if_known`` leaves them out."""
    pairs = [*always, *if_known]
    whole = F.create_map(*[x for name, column in pairs for x in (F.lit(name), F.col(f"{column}_text"))])
    names = [name for name, _ in always]
    return F.map_filter(whole, lambda k, v: v.isNotNull() | k.isin(names) if names else v.isNotNull())


def quarterly_financials() -> Column:
    """Figures of a 10-Q: revenue and EPS may be null, net income is there only when known."""
    return figures_map(
        [("revenue_bn", "revenue_bn"), ("eps_reported", "eps")], [("net_income_bn", "net_income_bn")]
    )


def annual_financials() -> Column:
    """Figures of a 10-K: only those that are known."""
    return figures_map([], [("revenue_bn", "revenue_bn"), ("eps_diluted", "eps"), ("net_income_bn", "net_income_bn")])


def quarter_of_filing() -> Column:
    """A 10-Q with figures as a quarter record."""
    named = Q.filing_quarter(F.col("period_of_report"), F.col("filing_date"))
    none, no_quotes = F.array().cast(S.TEXTS), F.array().cast(S.QUARTER["key_quotes"].dataType)
    return quarter_record(
        quarter=named["quarter"], fiscal_year=named["fiscal_year"], date=F.col("filing_date"),
        period_end=F.col("period_of_report"), speakers=none, financials=quarterly_financials(), key_quotes=no_quotes,
        key_themes=none, risks=none, tone=F.lit(""), source=F.lit(V.QUARTERLY_SOURCE),
    )


def annual_of_filing() -> Column:
    """A 10-K with figures as an annual record."""
    return F.struct(
        F.col("form"), F.col("filing_date").cast("string").alias("filing_date"),
        F.col("period_of_report").cast("string").alias("period_end"), annual_financials().alias("financials"),
    )


def quarter_records(filings: DataFrame, facts: DataFrame, n: int = V.QUARTERS) -> DataFrame:
    """Latest n 10-Q filings of each company as quarter records (``filing_no`` 1 newest)."""
    latest = latest_filings(filings, "10-Q", n)
    chosen = with_figure_texts(with_figures(latest, classify_facts(facts_of(facts, latest))))
    return chosen.select("ticker", "accession", "filing_no", quarter_of_filing().alias("record"))


def annual_records(filings: DataFrame, facts: DataFrame, n: int = V.ANNUALS) -> DataFrame:
    """Latest n 10-K filings of each company as annual records."""
    latest = latest_filings(filings, "10-K", n)
    chosen = with_figure_texts(with_figures(latest, classify_facts(facts_of(facts, latest))))
    return chosen.select("ticker", "accession", "filing_no", annual_of_filing().alias("record"))


def oldest_first(records: DataFrame, name: str) -> DataFrame:
    """The chosen filings of a company as a list, oldest first."""
    return records.groupBy("ticker").agg(ordered_list(-F.col("filing_no"), F.col("record")).alias(name))


def item_codes(items: Column) -> Column:
    """``2.02, 9.01`` as a list; blank entries dropped, a missing text is an empty list."""
    parts = F.transform(F.split(F.coalesce(items, F.lit("")), ","), X.strip)
    return F.filter(parts, lambda code: code != "")


def describe_codes(codes: Column) -> Column:
    """Description of each code in place; ``Item <code>`` for an unknown one."""
    return F.transform(
        codes, lambda c: X.lookup_default(V.ITEM_DESCRIPTIONS, c, F.concat(F.lit("Item "), c))
    )


def event_headline(name: Column, descriptions: Column) -> Column:
    what = F.when(F.size(descriptions) == 0, F.lit("SEC Filing (8-K)")).otherwise(F.array_join(descriptions, ", "))
    return F.concat(name, F.lit(": "), what)


def event_snippet(filing_date: Column, items: Column) -> Column:
    raw = F.coalesce(F.nullif(items, F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("8-K filed on "), filing_date.cast("string"), F.lit(". Items: "), raw, F.lit("."))


def event_tags(codes: Column) -> Column:
    return F.concat(codes, F.array(*[F.lit(t) for t in V.EVENT_TAGS]))


def news_of_filing(company: Column, filing_date: Column, items: Column) -> Column:
    """An 8-K as a news item."""
    codes = item_codes(items)
    return F.struct(
        filing_date.cast("string").alias("date"),
        F.lit(V.EVENT_SOURCE).alias("source"),
        event_headline(company, describe_codes(codes)).alias("headline"),
        event_snippet(filing_date, items).alias("snippet"),
        event_tags(codes).alias("tags"),
    )


def news_from_filings(filings: DataFrame, companies: DataFrame, n: int = V.EVENTS) -> DataFrame:
    """Latest n 8-K filings of each company as news items (``filing_no`` 1 newest)."""
    chosen = latest_filings(filings, "8-K", n).join(companies.select("ticker", "company"), "ticker", "inner")
    item = news_of_filing(F.col("company"), F.col("filing_date"), F.col("items"))
    return chosen.select("ticker", "accession", "filing_no", item.alias("item")).select(
        "ticker", "accession", "filing_no", "item.*"
    )


def collect_news(news: DataFrame, ord_by: str) -> DataFrame:
    """News items of a company as one list. Limit the items first."""
    item = F.struct("date", "source", "headline", "snippet", "tags")
    return news.groupBy("ticker").agg(ordered_list(F.col(ord_by), item).alias("news"))


def document_lists(
    companies: DataFrame, filings: DataFrame, facts: DataFrame | None = None, n_quarters: int = V.QUARTERS,
    n_years: int = V.ANNUALS, n_events: int = V.EVENTS,
) -> DataFrame:
    """``companies`` with their transcripts, annual filings and news.

    All lists come from one pass over the filings, one join to the facts and one
    grouping of the few filings that are kept; news items are worded after the
    join to the company. Without facts all figures are missing.
    """
    chosen = latest_of_forms(filings, {"10-Q": n_quarters, "10-K": n_years, "8-K": n_events})
    if facts is None:
        unknown = [F.lit(None).cast("string").alias(f"{n}_text") for n in ("revenue_bn", "net_income_bn", "eps")]
        figured = chosen.select("*", *unknown)
    else:
        statements = chosen.filter(F.col("form").isin("10-Q", "10-K"))
        figured = with_figure_texts(with_figures(chosen, classify_facts(facts_of(facts, statements))))
    no, form = F.col("filing_no"), F.col("form")
    event = F.struct("filing_date", "items")
    lists = figured.groupBy("ticker").agg(
        ordered_list(-no, quarter_of_filing(), form == "10-Q").alias("transcripts"),
        ordered_list(-no, annual_of_filing(), form == "10-K").alias("annual_filings"),
        ordered_list(no, event, form == "8-K").alias("events"),
    )
    news = F.transform("events", lambda e: news_of_filing(F.col("company"), e["filing_date"], e["items"]))
    return companies.join(lists, "ticker", "left").withColumn("news", news).drop("events")
