"""Queries on search hits and transcript pages."""

from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import html as H
from quarterdeck.functions import quarters as Q
from quarterdeck.functions import text as X
from quarterdeck.operators import extraction as E
from quarterdeck.operators import pages as P
from quarterdeck.operators import quarters as QT
from quarterdeck.plans.pages import page_quarters as page_quarter_plan
from quarterdeck.queries.catalog import as_of
from quarterdeck.queries.registry import query, strip, text
from quarterdeck.queries.views import table
from quarterdeck.sources.tables import read_pages, top_hits as first_hits

SITE = "example.com"

# The fold over a page's tags, as in ``functions/html.py``: an element of the list is a tag and what is open and done
# after it, since a list is reduced to a value of its elements' type.
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN_SQL = text(
    r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{name}\b{_ATTRIBUTES}>.*?(?:</{name}\s*>|\z)" for name in ("script", "style"))
    + rf"|<[!?/][^>]*(?:>|\z)|<[a-z]{_ATTRIBUTES}>|<[a-z][^>]*(?:>|\z)|(?:[^<]|<+[^a-z/!?<])+"
)
NAMES_SQL = "MAP {{" + ", ".join(f"{text(name)}: {text(char)}" for name, char in H.NAMED.items()) + "}}"
DECODED_SQL = f"""CASE WHEN contains(raw, '&') THEN array_to_string(list_transform(regexp_extract_all(raw, {text(H.REFERENCE)}),
    lambda r: coalesce({NAMES_SQL}[substr(r, 2)], r)), '') ELSE raw END"""
OPEN_TYPE, SPAN_TYPE = "STRUCT(name VARCHAR, pos BIGINT, mark INTEGER)[]", "STRUCT(name VARCHAR, pos BIGINT, mark INTEGER, stop BIGINT)[]"
_listed = "({})".format(", ".join(text(n) for n in (*H.BLOCKS, *H.REMOVED, *H.NOT_TEXT)))


def _closed(elements, stop):
    return f"""list_transform(list_filter({elements}, lambda e: e.mark > 0 OR e.name IN {_listed}),
        lambda e: {{{{'name': e.name, 'pos': e.pos, 'mark': e.mark, 'stop': {stop}}}}})"""


def _state(stack, spans):
    return f"{{{{'pos': t.pos, 'kind': t.kind, 'name': t.name, 'mark': t.mark, 'stack': {stack}, 'spans': {spans}}}}}"


_element = "[{{'name': t.name, 'pos': t.pos, 'mark': t.mark}}]"
_above = "coalesce(list_position(list_reverse(list_transform(acc.stack, lambda e: e.name)), t.name), 0)"
TEXTS_SQL = f"""
    cut AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, {TOKEN_SQL}), lambda x, i: {{{{'raw': x, 'pos': i - 1}}}}), recursive := true)
            FROM {{f_page}}),
    named AS (SELECT *, lower(regexp_extract(raw, {text(H.TAG_NAME)}, 1)) AS name FROM cut),
    kinds AS (SELECT page_id, pos::bigint AS pos, name, CASE WHEN NOT regexp_matches(raw, '^<[A-Za-z/!?]') THEN 'text'
            WHEN NOT regexp_matches(raw, '^</?[A-Za-z]') OR name IN ('script', 'style') THEN 'other' WHEN starts_with(raw, '</') THEN 'close'
            WHEN name IN ({", ".join(text(n) for n in H.CHILDLESS)}) OR ends_with(raw, '/>') THEN 'alone' ELSE 'open' END AS kind,
            CASE WHEN starts_with(raw, '</') THEN 0 WHEN regexp_matches(raw, {text(H.MARKED_ID)}) THEN 1
            WHEN regexp_matches(raw, {text(H.MARKED_CLASS)}) THEN 2 ELSE 0 END AS mark, {DECODED_SQL} AS said FROM named),
    folds AS (SELECT page_id, count(*) AS n, list_reduce(list_prepend({{{{'pos': -1::bigint, 'kind': '', 'name': '', 'mark': 0, 'stack': []::{OPEN_TYPE}, 'spans': []::{SPAN_TYPE}}}}},
            coalesce(list({{{{'pos': pos, 'kind': kind, 'name': name, 'mark': mark, 'stack': []::{OPEN_TYPE}, 'spans': []::{SPAN_TYPE}}}}} ORDER BY pos)
            FILTER (WHERE kind IN ('open', 'close', 'alone')), [])),
            lambda acc, t: CASE WHEN t.kind = 'open' THEN {_state(f"acc.stack || {_element}", "acc.spans")}
            WHEN t.kind = 'alone' THEN {_state("acc.stack", f"acc.spans || {_closed(_element, 't.pos')}")}
            WHEN {_above} > 0 THEN {_state(f"acc.stack[1:len(acc.stack) - {_above}]", f"acc.spans || {_closed(f'acc.stack[len(acc.stack) - {_above} + 1:]', 't.pos')}")}
            ELSE acc END) AS f FROM kinds GROUP BY page_id),
    spans AS (SELECT page_id, unnest(f.spans || {_closed("f.stack", "n")}, recursive := true) FROM folds),
    bodies AS (SELECT page_id, min({{{{'mark': mark, 'pos': pos, 'stop': stop}}}}) AS body FROM spans WHERE mark > 0 GROUP BY page_id),
    gone AS (SELECT page_id, pos, stop, false AS everywhere FROM spans JOIN bodies USING (page_id)
            WHERE name IN ('aside', 'figure') AND pos > body.pos AND pos < body.stop
            UNION ALL SELECT page_id, pos, stop, true FROM spans WHERE name IN ('template', 'rt', 'rp')),
    words AS (SELECT k.page_id, k.pos, k.said, EXISTS (SELECT 1 FROM gone g WHERE g.page_id = k.page_id AND g.pos < k.pos AND k.pos < g.stop) AS away,
            EXISTS (SELECT 1 FROM gone g WHERE g.page_id = k.page_id AND g.pos < k.pos AND k.pos < g.stop AND everywhere) AS hidden
            FROM kinds k WHERE kind = 'text'),
    blocks AS (SELECT s.page_id, s.pos, coalesce(string_agg({strip("w.said")}, '' ORDER BY w.pos), '') AS block FROM spans s JOIN bodies b ON b.page_id = s.page_id
            LEFT JOIN words w ON w.page_id = s.page_id AND w.pos > s.pos AND w.pos < s.stop AND NOT away
            WHERE s.name IN ('p', 'h2', 'h3') AND s.pos > body.pos AND s.pos < body.stop AND NOT EXISTS (SELECT 1 FROM gone g
            WHERE g.page_id = s.page_id AND g.pos < s.pos AND s.pos < g.stop AND NOT everywhere) GROUP BY s.page_id, s.pos),
    joined AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM blocks WHERE block <> '' GROUP BY page_id),
    visible AS (SELECT page_id, string_agg(said, '' ORDER BY pos) AS seen FROM words WHERE NOT hidden GROUP BY page_id),
    texts AS (SELECT p.page_id, p.url, p.html, joined.text, strftime(try_strptime(regexp_replace(replace(
            regexp_extract(seen, {text(V.CALL_DATE)}, 1), ',', ''), '\\s+', ' ', 'g'), '%B %d %Y'), '%Y-%m-%d') AS call_date
            FROM {{f_page}} p LEFT JOIN joined ON joined.page_id = p.page_id LEFT JOIN visible ON visible.page_id = p.page_id)"""


def _pages(spark, folder):
    return read_pages(table(spark, folder, "f_page")).select("page_id", "url", "html")


@query("WITH " + TEXTS_SQL + " SELECT page_id, text FROM texts")
def page_text(spark, folder):
    """Body texts of pages, unclosed and nested elements included."""
    return P.page_texts(_pages(spark, folder)).select("page_id", "text")


@query("WITH " + TEXTS_SQL + " SELECT page_id, text, call_date FROM texts")
def page_text_tree(spark, folder):
    """Body texts with call dates."""
    texts = P.page_texts(_pages(spark, folder))
    return texts.select("page_id", "text", Q.call_date(F.col("date_text")).cast("string").alias("call_date"))


@query("WITH " + TEXTS_SQL + " SELECT page_id, call_date FROM texts")
def page_dates(spark, folder):
    raw = Q.call_date_text(H.visible_text(F.col("html")))
    return _pages(spark, folder).select("page_id", raw.alias("raw")).select(
        "page_id", Q.call_date(F.col("raw")).cast("string").alias("call_date")
    )


BLOCK_SQL = f"regexp_extract(text, {text('(?i)' + V.PARTICIPANTS_BLOCK)}, 1)"
PAGE_NAMES_SQL = f"""list_sort(list_distinct(
    regexp_extract_all({BLOCK_SQL}, {text(V.NAME_AFTER_DASH)}, 1)
    || regexp_extract_all({BLOCK_SQL}, {text(V.NAME_BEFORE_DASH)}, 1)
    || list_filter(regexp_extract_all(text, {text(V.NAME_DASH_WORD)}, 1), lambda n: length(n) < 40)))"""
PAGE_REST_SQL = "regexp_extract(text, " + text(f"(?i)(?:{V.PAGE_QUESTIONS_START})(?s:.*)") + ")"


@query("WITH " + TEXTS_SQL + f"""
    SELECT page_id, array_to_string({PAGE_NAMES_SQL}, '; ') AS speakers FROM texts""")
def page_speakers(spark, folder):
    texts = P.page_texts(_pages(spark, folder))
    return texts.select("page_id", F.array_join(X.page_speakers(F.col("text")), "; ").alias("speakers"))


@query("SELECT doc_id, " + f"""
    CASE WHEN rest = '' THEN text ELSE {strip("substr(text, 1, length(text) - length(rest))")} END AS prepared_remarks,
    {strip("rest")} AS questions_and_answers
    FROM (SELECT doc_id, text, {PAGE_REST_SQL} AS rest FROM (
        SELECT event_no AS doc_id, full_text || CASE event_no % 4 WHEN 0 THEN ' Question & Answer part' WHEN 1
            THEN chr(10) || 'Q&A session' ELSE '' END AS text FROM {{f_call}}) a) c""")
def page_sections(spark, folder):
    no = F.col("event_no") % 4
    end = F.when(no == 0, " Question & Answer part").when(no == 1, "\nQ&A session").otherwise("")
    texts = table(spark, folder, "f_call").select(F.col("event_no").alias("doc_id"),
                                                  F.concat("full_text", end).alias("text"))
    return texts.select("doc_id", X.page_sections(F.col("text")).alias("s")).select("doc_id", "s.*")


REASON_SQL = """CASE WHEN url IS NULL THEN 'no transcript found' WHEN coalesce(length(html), 0) = 0 THEN 'fetch failed'
    WHEN coalesce(length(text), 0) < 500 THEN 'extraction failed' END"""


@query("WITH " + TEXTS_SQL + f"""
    SELECT page_id, coalesce(length(text), 0) AS n_chars, {REASON_SQL} AS reject_reason FROM texts""")
def page_gate(spark, folder):
    gated = P.quality_gate(P.page_texts(_pages(spark, folder)))
    return gated.select("page_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "reject_reason")


@query("""
    SELECT ticker, query_no::bigint AS query_no, rank, href FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, query_no ORDER BY rank) AS n FROM {f_hit}) h WHERE n <= 3""")
def top_hits(spark, folder):
    hits = first_hits(table(spark, folder, "f_hit"), 3, ["ticker", "query_no"])
    return hits.select("ticker", F.col("query_no").cast("long").alias("query_no"), "rank", "href")


PICKED_SQL = f"""
    fits AS (SELECT *, lower(href || ' ' || coalesce(title, '')) AS place FROM {{f_hit}} WHERE rank <= 8),
    picked AS (SELECT ticker, year, q, arg_min(page_url, query_no * 100 + rank) AS page_url,
               arg_min(href, query_no * 100 + rank) AS url
               FROM fits WHERE contains(lower(href), '{SITE}') AND (contains(place, 'q' || q || '-' || year)
               OR contains(place, 'q' || q || ' ' || year)) GROUP BY ticker, year, q)"""


@query("WITH " + PICKED_SQL + """
    SELECT ticker, year::bigint AS year, q::bigint AS q, url, cast(contains(lower(url), lower(ticker)) AS string)
           AS entity_match FROM picked""")
def picked_pages(spark, folder):
    picked = P.pick_page(table(spark, folder, "f_hit"), SITE, entity_match=True)
    return picked.select("ticker", F.col("year").cast("long").alias("year"), F.col("q").cast("long").alias("q"), "url",
                         F.col("entity_match").cast("string").alias("entity_match"))


BLOCKS_SQL = """
    blocks AS (SELECT ticker, query_no, string_agg('SOURCE: ' || href || chr(10) || 'TITLE:  ' || coalesce(title, '')
               || chr(10) || 'BODY:   ' || coalesce(body, '') || chr(10), chr(10) ORDER BY rank) AS snippets
               FROM (SELECT *, row_number() OVER (PARTITION BY ticker, query_no ORDER BY rank) AS n FROM {f_hit}) h
               WHERE n <= 6 GROUP BY ticker, query_no)"""


def blocks(spark, folder):
    return E.snippet_blocks(table(spark, folder, "f_hit"), ["ticker", "query_no"], V.HITS_PER_QUARTER)


@query("WITH " + BLOCKS_SQL + " SELECT ticker, query_no::bigint AS query_no, snippets FROM blocks")
def snippet_blocks(spark, folder):
    return blocks(spark, folder).withColumn("query_no", F.col("query_no").cast("long"))


VARIED_SQL = """CASE WHEN right(ticker, 1) = '1' THEN '[Search failed: timeout]' WHEN right(ticker, 1) = '2'
    THEN chr(10) || ' ' ELSE snippets END"""


@query("WITH " + BLOCKS_SQL + f"""
    SELECT ticker, query_no::bigint AS query_no, length(snippets) AS n_chars
    FROM (SELECT ticker, query_no, {VARIED_SQL} AS snippets FROM blocks) b
    WHERE {strip("snippets")} <> '' AND NOT contains(snippets, '[Search failed')""")
def searched_only(spark, folder):
    """Some searches fail and some find nothing."""
    varied = blocks(spark, folder).withColumn("snippets", F.expr(VARIED_SQL.replace("chr(10)", "char(10)")))
    return E.keep_searched(varied).select("ticker", F.col("query_no").cast("long").alias("query_no"),
                                          F.length("snippets").cast("long").alias("n_chars"))


@query("""
    SELECT ticker, year, q, kind, query FROM (
    WITH grid AS (SELECT ticker, company, year(d)::bigint AS year, quarter(d)::bigint AS q FROM (
        SELECT *, DATE '2002-01-01' - INTERVAL 3 MONTH * i AS d FROM {f_company}, (SELECT unnest(range(1, 9)) AS i)) x)
    SELECT *, 'quarter' AS kind, company || ' ' || ticker || ' Q' || q || ' ' || year
        || ' earnings call transcript highlights key quotes' AS query FROM grid
    UNION ALL SELECT *, 'page 1', 'site:example.com ' || company || ' Q' || q || ' ' || year
        || ' earnings call transcript' FROM grid
    UNION ALL SELECT *, 'page 2', 'site:example.com ' || ticker || ' Q' || q || ' ' || year
        || ' earnings call transcript' FROM grid
    UNION ALL SELECT ticker, company, 2002, 1, 'news', company || ' ' || ticker || ' news 2002' FROM {f_company}) u""")
def search_queries(spark, folder):
    companies = table(spark, folder, "f_company").select("ticker", "company")
    grid = QT.quarter_grid(companies, as_of(), 8)

    def shown(queries, kind):
        return queries.select("ticker", F.col("year").cast("long").alias("year"), F.col("q").cast("long").alias("q"),
                              kind.alias("kind"), "query")

    news = E.news_queries(companies, F.year(as_of())).select("*", F.lit(2002).alias("year"), F.lit(1).alias("q"))
    return (
        shown(E.quarter_queries(grid), F.lit("quarter"))
        .unionByName(shown(E.page_queries(grid, SITE), F.concat(F.lit("page "), F.col("query_no").cast("string"))))
        .unionByName(shown(news, F.lit("news")))
    )


def _marker_sql(column):
    rests = ", ".join(
        f"nullif(regexp_extract({column}, {text(f'(?:{m})(?s:.*)')}), '')" for m in V.FINANCIALS_MARKERS
    )
    return f"coalesce({rests})"


def chunk_sql(column):
    before = f"coalesce(length({column}) - length({_marker_sql(column)}), 0)"
    return f"substr({column}, greatest(0, {before} - 200) + 1, 3000)"


@query(f"SELECT event_no, {chunk_sql('full_text')} AS chunk FROM {{f_call}}")
def financials_chunks(spark, folder):
    calls = table(spark, folder, "f_call")
    return calls.select("event_no", X.financials_chunk(F.col("full_text")).alias("chunk"))


@query("WITH " + TEXTS_SQL + "," + PICKED_SQL + f"""
    SELECT g.ticker, g.company, g.year, g.q, url, {REASON_SQL} AS reject_reason, coalesce(length(text), 0) AS n_chars,
           call_date, array_to_string({PAGE_NAMES_SQL}, '; ') AS speakers
    FROM (SELECT ticker, company, year(d)::bigint AS year, quarter(d)::bigint AS q FROM (
            SELECT *, DATE '2002-01-01' - INTERVAL 3 MONTH * i AS d FROM {{f_company}},
                   (SELECT unnest(range(1, 9)) AS i)) x) g
    LEFT JOIN (SELECT ticker, year, q, page_url AS url FROM picked) p
        ON p.ticker = g.ticker AND p.year = g.year AND p.q = g.q
    LEFT JOIN (SELECT url AS text_url, html, text, call_date FROM texts) t ON t.text_url = p.url""")
def page_quarters(spark, folder):
    """Every company's quarters with the page chosen for each, or the reason there is none."""
    hits = table(spark, folder, "f_hit")
    # hits carry links with a slug; pages are stored under the plain address
    by_link = hits.select("href", "page_url")
    pages = _pages(spark, folder).join(by_link.withColumnRenamed("page_url", "url"), "url").select(
        F.col("href").alias("url"), F.col("url").alias("page_url"), "html"
    )
    companies = table(spark, folder, "f_company").select("ticker", "company")
    found = page_quarter_plan(companies, hits, pages, as_of(), site=SITE)
    return found.select(
        "ticker", "company", F.col("year").cast("long").alias("year"), F.col("q").cast("long").alias("q"),
        F.col("page_url").alias("url"), "reject_reason",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "call_date",
        F.array_join("page_speakers", "; ").alias("speakers"),
    )
