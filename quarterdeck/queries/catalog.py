"""Queries on the registry and on company documents."""

from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.operators import catalog as C
from quarterdeck.operators import quarters as QT
from quarterdeck.operators.shared import scratch_folder
from quarterdeck.plans.filings import registry_updates, seed_companies
from quarterdeck.queries.registry import query, tenth, text
from quarterdeck.queries.views import AS_OF, table
from quarterdeck.sinks.files import write_company_table
from quarterdeck.sinks.registry import commit_registry, read_registry_version
from quarterdeck.sources.documents import read_company_table
from quarterdeck.sources.tables import company_info


def as_of():
    return F.lit(AS_OF).cast("date")


def documents(spark, folder, figures=True):
    """The filing documents of all companies, with their file names; listings do without the figures."""
    companies = table(spark, folder, "f_company").select("ticker", "company", "sector")
    facts = table(spark, folder, "f_fact") if figures else None
    docs = seed_companies(companies, table(spark, folder, "f_filing"), facts, last_updated=as_of())
    return docs.withColumn("file", F.concat(F.lower("ticker"), F.lit(".json")))


def full_registry(spark, folder):
    """Registry entries with notes, labels and themes."""
    none = F.array().cast("array<string>")
    return table(spark, folder, "f_registry").select(
        "pos", "name", "ticker", "file", F.concat(F.lit("Note "), "ticker").alias("fiscal_year_note"),
        F.array(F.lit("Q1 2001")).alias("transcripts"), F.lit(0).cast("long").alias("transcript_count"),
        F.lit(0).cast("long").alias("news_items"), F.lit(None).cast("string").alias("next_earnings"),
        none.alias("primary_themes"),
    )


@query("SELECT name FROM {f_registry}")
def list_companies(spark, folder):
    return C.list_companies(table(spark, folder, "f_registry"))


@query("""
    WITH keys AS (SELECT pos AS key_no, CASE pos % 4 WHEN 0 THEN upper(company) WHEN 1 THEN lower(ticker)
                  WHEN 2 THEN company ELSE 'no ' || company END AS key FROM {f_company}),
    entries AS (SELECT lower(name) AS k, pos, name, ticker FROM {f_registry}
                UNION SELECT lower(ticker), pos, name, ticker FROM {f_registry}),
    best AS (SELECT k, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(ticker, pos) AS ticker
             FROM entries GROUP BY k)
    SELECT key_no, key, name, ticker, cast(best.pos IS NOT NULL AS string) AS found
    FROM keys LEFT JOIN best ON lower(key) = k""")
def lookup_batch(spark, folder):
    company = table(spark, folder, "f_company")
    way = F.col("pos") % 4
    key = (F.when(way == 0, F.upper("company")).when(way == 1, F.lower("ticker")).when(way == 2, F.col("company"))
           .otherwise(F.concat(F.lit("no "), "company")))
    keys = company.select(F.col("pos").alias("key_no"), key.alias("key"))
    found = C.lookup_batch(table(spark, folder, "f_registry"), keys)
    return found.select("key_no", "key", "name", "ticker", F.col("found").cast("string").alias("found"))


LIST_SIZES = """
    sizes AS (SELECT ticker, least(count(*) FILTER (form = '10-Q'), 8) AS n_quarters,
              least(count(*) FILTER (form = '8-K'), 6) AS n_news, least(count(*) FILTER (form = '10-K'), 3) AS n_annual
              FROM {f_filing} GROUP BY ticker)"""


@query("WITH " + LIST_SIZES + """
    SELECT c.pos, c.company AS name, c.ticker, c.sector, coalesce(n_quarters, 0) AS transcript_count,
           coalesce(n_news, 0) AS news_count
    FROM {f_company} c JOIN {f_registry} r ON c.file = r.file LEFT JOIN sizes s ON s.ticker = c.ticker""")
def company_detail(spark, folder):
    return C.company_detail(table(spark, folder, "f_registry"), documents(spark, folder, figures=False))


@query("""
    SELECT ticker, company, (SELECT count(*) FROM {f_quarter} q WHERE q.ticker = c.ticker) AS transcript_count,
           (SELECT count(*) FROM {f_news} n WHERE n.ticker = c.ticker) AS news_count
    FROM {f_company} c""")
def company_counts(spark, folder):
    companies = table(spark, folder, "f_company").select("ticker", "company")
    return C.count_by_company(companies, table(spark, folder, "f_quarter"), table(spark, folder, "f_news"))


@query("SELECT ticker, company FROM {f_company} WHERE file NOT IN (SELECT file FROM {f_registry})")
def unregistered_documents(spark, folder):
    docs = table(spark, folder, "f_company").select("ticker", "company", "file")
    return C.unregistered(table(spark, folder, "f_registry"), docs).select("ticker", "company")


ONE_SQL = "WITH " + LIST_SIZES + """
    SELECT c.ticker, c.company, c.sector, '2002-01-01' AS last_updated, coalesce(n_quarters, 0) AS n_quarters,
           coalesce(n_news, 0) AS n_news, coalesce(n_annual, 0) AS n_annual
    FROM {f_company} c LEFT JOIN sizes s ON s.ticker = c.ticker
    WHERE lower(c.company) = 'customer#000000007' AND c.file IN (SELECT file FROM {f_registry})"""


def _one(found):
    return found.select(
        "ticker", "company", "sector", "last_updated", F.size("transcripts").cast("long").alias("n_quarters"),
        F.size("news").cast("long").alias("n_news"), F.size("annual_filings").cast("long").alias("n_annual"),
    )


@query(ONE_SQL)
def company_document(spark, folder):
    """One company's document, made of its own filings and facts only."""
    registry, key = table(spark, folder, "f_registry"), "CUSTOMER#000000007"
    companies = C.one_company(registry, table(spark, folder, "f_company"), key).select("ticker", "company", "sector")
    filings = table(spark, folder, "f_filing").join(F.broadcast(companies.select("ticker")), "ticker", "left_semi")
    return _one(seed_companies(companies, filings, table(spark, folder, "f_fact"), last_updated=as_of()))


@query(ONE_SQL)
def stored_document(spark, folder):
    """The same document out of the written table of all companies: one folder of it is read."""
    path = scratch_folder(spark)
    write_company_table(documents(spark, folder, figures=False), path)
    return _one(C.company_document(table(spark, folder, "f_registry"), read_company_table(spark, path), "CUSTOMER#000000007"))


NEWS_SQL = """
    code_list AS (SELECT accession, list_filter(list_transform(string_split(coalesce(items, ''), ','),
                  lambda x: trim(x)), lambda x: x <> '') AS codes FROM {f_filing} WHERE form = '8-K'),
    names AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({text(code)}, {text(what)})" for code, what in V.ITEM_DESCRIPTIONS.items()
) + """) t(code, what)),
    described AS (SELECT accession, string_agg(coalesce(what, 'Item ' || code), ', ' ORDER BY i) AS whats,
                  string_agg(code, '|' ORDER BY i) AS codes
                  FROM (SELECT accession, unnest(codes) AS code, generate_subscripts(codes, 1) AS i FROM code_list)
                  LEFT JOIN names USING (code) GROUP BY accession),
    recent AS (SELECT f.*, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession DESC) AS n
               FROM {f_filing} f WHERE form = '8-K'),
    event_news AS (SELECT r.ticker, r.accession, r.n AS filing_no, cast(filing_date AS string) AS date,
             'SEC EDGAR (8-K)' AS source,
             company || ': ' || coalesce(whats, 'SEC Filing (8-K)') AS headline,
             '8-K filed on ' || cast(filing_date AS string) || '. Items: ' ||
             CASE WHEN coalesce(items, '') = '' THEN 'N/A' ELSE items END || '.' AS snippet,
             CASE WHEN codes IS NULL THEN '' ELSE codes || '|' END || '8-K|SEC Filing' AS tags
             FROM recent r JOIN {f_company} c ON c.ticker = r.ticker LEFT JOIN described d ON d.accession = r.accession
             WHERE r.n <= 6)"""


@query("WITH " + NEWS_SQL + """
    SELECT ticker, filing_no - 1 AS pos, date, source, headline, snippet, tags FROM event_news""")
def news_flat(spark, folder):
    news = C.news_of(documents(spark, folder, figures=False))
    return news.select("ticker", F.col("pos").cast("long").alias("pos"), "date", "source", "headline", "snippet",
                       F.array_join("tags", "|").alias("tags"))


@query("""
    SELECT ticker, pos, 0::bigint AS tag_pos, source AS tag FROM {f_news}
    UNION ALL SELECT ticker, pos, 1, json_extract_string(snippet, '$.k') FROM {f_news}""")
def tags_flat(spark, folder):
    news = table(spark, folder, "f_news")
    tagged = news.withColumn("tags", F.array("source", F.get_json_object("snippet", "$.k")))
    return QT.tags_of(tagged).withColumn("tag_pos", F.col("tag_pos").cast("long"))


# figures of the 10-Q and 10-K filings, as both records and documents show them
FIGURES_SQL = """
    usable AS (SELECT accession, ord, lower(label) AS label, period, period_pos, val, contains(lower(label), 'revenue')
                 OR contains(lower(label), 'net sales') AS is_rev,
                 NOT abstract AND dim IS NULL AND val IS NOT NULL AND NOT isnan(val) AS ok
               FROM {f_fact} WHERE regexp_matches(period, '^[0-9]')),
    first_pos AS (SELECT accession, min(period_pos) AS period_pos FROM usable GROUP BY accession),
    ranked AS (SELECT u.*, row_number() OVER (PARTITION BY u.accession, is_rev AND ok ORDER BY ord) = 1
                 AND is_rev AND ok AS takes
               FROM usable u JOIN first_pos p ON p.accession = u.accession AND p.period_pos = u.period_pos),
    chained AS (SELECT accession, min(period) AS period, arg_min(val, ord) FILTER (takes) AS revenue,
               arg_max(val, ord) FILTER (ok AND trim(label) IN ('net income', 'net income:')) AS net_income,
               arg_max(val, ord) FILTER (ok AND NOT takes AND contains(label, 'diluted')
                 AND contains(label, 'per share') AND contains(label, 'dollar')) AS eps_diluted
             FROM ranked GROUP BY accession),
    figures AS (SELECT *, """ + tenth("nullif(revenue, 0) / 1000000000::double") + """ AS revenue_bn,
             nullif(eps_diluted, 0) AS eps, """ + tenth("nullif(net_income, 0) / 1000000000::double") + """ AS net_income_bn
             FROM chained)"""

RECORDS_SQL = FIGURES_SQL + """,
    newest AS (SELECT f.*, row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, accession DESC) AS n
               FROM {f_filing} f),
    records AS (SELECT ticker, n.accession, form, n AS filing_no,
               coalesce('Q' || quarter(period_of_report) || ' ' || year(period_of_report),
                        'Filing ' || cast(filing_date AS string)) AS quarter,
               coalesce(cast(year(period_of_report) AS string), '') AS fiscal_year,
               cast(filing_date AS string) AS date, cast(period_of_report AS string) AS period_end,
               revenue_bn, eps, net_income_bn
               FROM newest n LEFT JOIN figures g ON g.accession = n.accession
               WHERE n <= CASE form WHEN '10-Q' THEN 8 WHEN '10-K' THEN 3 ELSE 6 END)"""


@query("WITH " + NEWS_SQL + "," + RECORDS_SQL + """,
    q AS (SELECT ticker, string_agg(quarter || '=' || coalesce(revenue_bn::string, 'null'), '; ' ORDER BY filing_no DESC)
          AS quarters FROM records WHERE form = '10-Q' GROUP BY ticker),
    a AS (SELECT ticker, string_agg(coalesce(period_end, 'null') || '=' || coalesce(net_income_bn::string, 'null'), '; '
          ORDER BY filing_no DESC) AS annual FROM records WHERE form = '10-K' GROUP BY ticker),
    e AS (SELECT ticker, string_agg(headline, '; ' ORDER BY filing_no) AS news FROM event_news GROUP BY ticker)
    SELECT c.ticker, c.company, c.sector, coalesce(quarters, '') AS quarters, coalesce(annual, '') AS annual,
           coalesce(news, '') AS news
    FROM {f_company} c LEFT JOIN q USING (ticker) LEFT JOIN a USING (ticker) LEFT JOIN e USING (ticker)""")
def assembled_companies(spark, folder):
    def shown(column, name, figure):
        return F.array_join(F.transform(column, lambda r: F.concat(
            F.coalesce(r[name], F.lit("null")), F.lit("="),
            F.coalesce(F.try_element_at(r["financials"], F.lit(figure)), F.lit("null")))), "; ")

    return documents(spark, folder).select(
        "ticker", "company", "sector", shown(F.col("transcripts"), "quarter", "revenue_bn").alias("quarters"),
        shown(F.col("annual_filings"), "period_end", "net_income_bn").alias("annual"),
        F.array_join(F.col("news.headline"), "; ").alias("news"),
    )


@query("WITH " + LIST_SIZES + """,
    updates AS (SELECT c.ticker, c.company || ' Inc.' AS name, coalesce(n_quarters, 0) AS q, coalesce(n_news, 0) AS n,
                c.pos AS update_no FROM {f_company} c LEFT JOIN sizes s USING (ticker) WHERE sector <> 'FURNITURE')
    SELECT cast(r.ticker IS NULL AS string) AS appended, coalesce(r.pos, u.update_no) AS pos,
           coalesce(u.name, r.name) AS name, coalesce(r.ticker, u.ticker) AS ticker,
           CASE WHEN u.ticker IS NULL THEN r.file ELSE lower(u.ticker) || '.json' END AS file,
           CASE WHEN r.ticker IS NULL THEN '' ELSE 'Note ' || r.ticker END AS fiscal_year_note,
           CASE WHEN r.ticker IS NULL THEN '' ELSE 'Q1 2001' END AS labels,
           coalesce(u.q, 0) AS transcript_count, coalesce(u.n, 0) AS news_items
    FROM {f_registry} r FULL JOIN updates u ON r.ticker = u.ticker""")
def registry_upsert(spark, folder):
    docs = documents(spark, folder, figures=False).filter(F.col("sector") != "FURNITURE")
    updates = registry_updates(docs, F.substring("ticker", 2, 9).cast("long")).withColumn(
        "name", F.concat("name", F.lit(" Inc."))
    )
    after = C.upsert_registry(full_registry(spark, folder), updates)
    return after.select(
        F.col("appended").cast("string").alias("appended"), "pos", "name", "ticker", "file", "fiscal_year_note",
        F.array_join("transcripts", "|").alias("labels"), "transcript_count", "news_items",
    )


@query("""
    WITH updates AS (SELECT ticker, company || ' Inc.' AS name, pos AS update_no FROM {f_company} WHERE sector <> 'FURNITURE'),
    fresh AS (SELECT u.* FROM updates u WHERE ticker NOT IN (SELECT ticker FROM {f_registry}))
    SELECT pos, coalesce(u.name, r.name) AS name, r.ticker, 2::bigint AS versions FROM {f_registry} r LEFT JOIN updates u ON r.ticker = u.ticker
    UNION ALL SELECT (SELECT max(pos) + 1 FROM {f_registry}) + update_no - (SELECT min(update_no) FROM fresh), name, ticker, 2 FROM fresh""")
def registry_versions(spark, folder):
    """The registry as its second version has it: committed, read, updated and committed to the same address."""
    address = scratch_folder(spark)
    commit_registry(full_registry(spark, folder), address)
    companies = table(spark, folder, "f_company").filter("sector <> 'FURNITURE'")
    updates = companies.select("ticker", F.concat("company", F.lit(" Inc.")).alias("name"), F.lit(0).cast("long").alias("transcript_count"),
                               F.lit(0).cast("long").alias("news_items"), F.col("pos").alias("update_no"))
    last = commit_registry(C.upsert_registry(read_registry_version(spark, address), updates), address)
    return read_registry_version(spark, address).select("pos", "name", "ticker", F.lit(last).cast("long").alias("versions"))


@query("""
    SELECT ticker, CASE WHEN balance < 0 THEN ticker WHEN sector = 'MACHINERY' THEN company
                        ELSE 'Short ' || company END AS company,
           CASE WHEN balance < 0 OR sector = 'BUILDING' THEN 'Unknown' ELSE sector END AS sector,
           CASE WHEN balance < 0 THEN 'Unknown' ELSE industry END AS industry
    FROM {f_company}""")
def company_infos(spark, folder):
    """One sector has long names, one has no sector given; companies in debt have no information at all."""
    company = table(spark, folder, "f_company")
    sector = F.col("sector")
    info = company.filter("balance >= 0").select(
        "ticker",
        F.when(sector == "MACHINERY", F.col("company")).otherwise(F.lit("")).alias("longName"),
        F.concat(F.lit("Short "), "company").alias("shortName"),
        F.when(sector != "BUILDING", sector).alias("sector"), "industry",
    )
    return company_info(company.select("ticker"), info)
