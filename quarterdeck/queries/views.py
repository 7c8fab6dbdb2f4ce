"""Research tables derived from the driver's tables.

Each view is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for
another view or a driver table. Remainders (``%``) only choose which variant of
a row is made: every row of a table takes part.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

AS_OF = "2002-01-01"

VIEWS = {
    # companies: every customer; those with a balance of 0 or more are registered
    "f_company": """
        SELECT 'C' || lpad(cast(c_custkey AS string), 9, '0') AS ticker, c_name AS company, c_mktsegment AS sector,
               'Trade ' || cast(c_nationkey AS string) AS industry,
               'c' || lpad(cast(c_custkey AS string), 9, '0') || '.json' AS file, c_custkey AS pos, c_acctbal AS balance
        FROM {customer}""",
    "f_registry": """
        SELECT pos, company AS name, ticker, file FROM {f_company} WHERE balance >= 0""",
    # line revenue is summed per order first, so that a large order is one row before the join; sums are whole
    # numbers (hundredths of a cent), which are exact in any order and cheap to add
    "f_order_revenue": """
        SELECT l_orderkey, count(*) AS n_lines,
               sum(cast(round(l_extendedprice * 100) AS bigint) * (100 - cast(round(l_discount * 100) AS bigint)))
                   AS units
        FROM {lineitem} GROUP BY l_orderkey""",
    "f_quarter_sum": """
        SELECT o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, cast(max(o_orderdate) AS date) AS d,
               cast(sum(n_lines) AS bigint) AS n_lines, cast(sum(units) AS double) / 10000 AS revenue
        FROM {orders} JOIN {f_order_revenue} ON o_orderkey = l_orderkey
        GROUP BY o_custkey, year(o_orderdate), quarter(o_orderdate)""",
    # the documents of two market segments list their quarters newest first
    "f_quarter": """
        SELECT 'C' || lpad(cast(o_custkey AS string), 9, '0') AS ticker, c_name AS company,
               'Q' || cast(q AS string) || ' ' || cast(y AS string) AS quarter, cast(d AS string) AS date,
               n_lines, revenue, c_mktsegment AS sector,
               row_number() OVER (PARTITION BY o_custkey ORDER BY
                   CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN -(y * 4 + q) ELSE y * 4 + q END) - cast(1 AS bigint) AS pos
        FROM {f_quarter_sum} JOIN {customer} ON o_custkey = c_custkey""",
    # which kinds of line an order has, as numbers that are hashed and combined before the shuffle
    "f_item_kind": """
        SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS k1,
               max(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS k2,
               max(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS k3,
               max(CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) AS k4,
               max(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) AS k5,
               max(CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END) AS k6,
               max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS k7
        FROM {lineitem} GROUP BY l_orderkey""",
    # 8-K items: one code per kind of line, with blanks and empty parts that must go; low-priority orders that are
    # still pending have no period
    "f_filing": """
        SELECT 'C' || lpad(cast(o_custkey AS string), 9, '0') AS ticker, cast(o_orderkey AS string) AS accession,
               CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-K' ELSE '10-Q' END AS form,
               cast(o_orderdate AS date) AS filing_date,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL
                    ELSE cast(date_trunc('quarter', o_orderdate) AS date) - 1 END AS period_of_report,
               CASE k1 WHEN 1 THEN '2.02, ' ELSE '' END || CASE k2 WHEN 1 THEN '9.01,' ELSE '' END
               || CASE k3 WHEN 1 THEN '5.02,' ELSE '' END || CASE k4 WHEN 1 THEN ' 8.01 ,' ELSE '' END
               || CASE k5 WHEN 1 THEN '6.99,' ELSE '' END || CASE k6 WHEN 1 THEN '5.07,' ELSE '' END
               || CASE WHEN k7 = 1 THEN '1.01' WHEN k7 = 0 THEN '' END AS items
        FROM {orders} LEFT JOIN {f_item_kind} ON o_orderkey = l_orderkey""",
    # statement rows: a revenue-like EPS label, costs before sales, nulls, NaN, zero, abstract and dimension rows
    "f_fact": """
        SELECT cast(l_orderkey AS string) AS accession,
               l_linenumber * cast(1000000000000000000 AS bigint) + l_partkey * 100000000
                   + cast(round(l_extendedprice * 100) AS bigint) AS ord,
               CASE l_linenumber WHEN 1 THEN 'Cost of Revenue' WHEN 2 THEN 'Total Net Sales' WHEN 3 THEN ' Net Income '
                    WHEN 4 THEN 'Revenue per share, diluted (in dollars per share)'
                    WHEN 5 THEN 'Earnings per share, diluted (in dollars per share)'
                    WHEN 6 THEN 'Net income:' ELSE 'Gross margin' END AS label,
               l_tax = 0.08 AS abstract,
               CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 'Segment' END AS dim,
               CASE WHEN l_returnflag = 'N' AND l_quantity < 10 THEN 'units'
                    WHEN l_linestatus = 'O' THEN '2001-06-30' ELSE '2000-06-30' END AS period,
               CASE WHEN l_returnflag = 'N' AND l_quantity < 10 THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END
                   AS period_pos,
               CASE WHEN l_discount = 0.1 THEN NULL WHEN l_discount = 0.09 THEN cast('NaN' AS double)
                    WHEN l_discount = 0.08 THEN cast(0 AS double)
                    WHEN l_linenumber IN (4, 5) THEN l_quantity / 10
                    ELSE round(l_extendedprice * 100) * 1000 END AS val
        FROM {lineitem}""",
    # statement rows as JSON objects: a third of the filings has two periods, newest first, a third one and a column of
    # units before it, a third none; of two-period filings every fifth row has no value in its first
    "f_statement": """
        SELECT cast(l_orderkey AS string) AS accession, l_linenumber * cast(1000000000000000000 AS bigint) + l_partkey AS ord,
               '{{"label": "Line ' || cast(l_linenumber AS string) || '", "units": "USD", '
               || CASE l_orderkey % 3 WHEN 0 THEN '"2001-06-30": ' || CASE WHEN l_partkey % 5 = 0 THEN 'null' ELSE cast(l_partkey AS string) END
                        || ', "2000-06-30": ' || cast(l_suppkey AS string) || ', '
                    WHEN 1 THEN '"1999-12-31": "' || cast(l_suppkey AS string) || '", ' ELSE '' END
               || '"abstract": ' || CASE WHEN l_tax = 0.08 THEN 'true' ELSE 'false' END || ', "dimension": null}}' AS record,
               l_orderkey % 3 AS kind, l_linenumber AS line, CASE WHEN l_partkey % 5 > 0 THEN cast(l_partkey AS double) END AS newest,
               cast(l_suppkey AS double) AS older, l_tax = 0.08 AS is_abstract
        FROM {lineitem}""",
    # news: every event of a user; errors have no date
    "f_news": """
        SELECT 'C' || lpad(cast(user_id AS string), 9, '0') AS ticker, event_id AS pos,
               CASE WHEN event_type <> 'error' THEN cast(cast(ts AS date) AS string) END AS date, event_type AS source,
               'Event ' || cast(event_id AS string) || ' by ' || event_type AS headline, props AS snippet
        FROM {events}""",
    # call texts: twelve whole documents a company, with an opening and an end that vary
    "f_call": """
        SELECT 'D' || lpad(cast(cast(floor(doc_id / 12) AS bigint) AS string), 9, '0') AS ticker,
               'Source ' || source || ' Group' AS company,
               doc_id AS event_no, cast(2000 + floor((doc_id % 12) / 4) AS int) AS year, cast(doc_id % 4 + 1 AS int) AS quarter,
               CASE WHEN doc_id % 3 <> 0 THEN '2001-0' || cast(doc_id % 4 + 1 AS string) || '-15' END
                   AS conference_date,
               CASE doc_id % 6
                   WHEN 0 THEN 'Dana White, Chief Executive Officer, and Omar Reed - VP of Investor Relations. '
                   WHEN 1 THEN 'Ann B. Lee — CFO opens. Diluted earnings came to $' || cast(n_chars % 97 AS string)
                        || '.25 a share. ' || chr(10)
                   WHEN 2 THEN 'EPS was fine' || chr(10) || 'and earnings per share rose to 3.5. '
                   WHEN 3 THEN '' ELSE 'Good day. ' END
               || text ||
               CASE doc_id % 7
                   WHEN 0 THEN chr(10) || 'I will turn the call over to Maria Lopez. Thank you, John Smith. Thanks, Al.'
                        || ' We saw revenue of $' || cast(n_chars AS string) || '.5 billion. '
                        || 'We will now open the line for one question each.' || chr(10) || 'Operator: go.'
                   WHEN 1 THEN ' Revenue of 1,' || cast(100 + n_chars % 900 AS string) || ',000.5 Million. '
                        || '🙂 The Q&A session starts. Our first question is from Eve Stone.'
                   WHEN 2 THEN ' revenue of 1.2.3 million. Please turn it over to Ian Black'
                   WHEN 3 THEN chr(10) || 'Operator: the next question comes from Zoe Hill. Thank you Max Power.'
                   WHEN 4 THEN ' revenue of $12345678 B' ELSE '' END AS full_text
        FROM {documents}""",
    # transcript pages: the article is marked by id, by class, or not at all; call facts are put in front
    "f_page": """
        SELECT page_id, url,
               replace(html, '<article>',
                   CASE WHEN url LIKE 'http://%' THEN '<article id="article-body-transcript">'
                        WHEN url LIKE 'https://blog.%' THEN '<article>'
                        ELSE '<article class="main article-body">' END ||
                   '<p>' || CASE page_id % 4
                        WHEN 0 THEN 'DATE Wednesday, July ' || cast(page_id % 31 + 1 AS string) || ', 2001 at 4:30 p.m.'
                        WHEN 1 THEN 'Date: Friday, february ' || cast(page_id % 31 + 1 AS string) || ' 2001'
                        WHEN 2 THEN 'DATE: Monday, Brumaire 9, 2001' ELSE 'No date' END ||
                   '</p><h2>Call Participants</h2><p>Chief Executive Officer — Jane Doe</p>'
                   || '<p>Carl D. Roe -- CFO</p><aside><p>Ad</p></aside><h3> Prepared Remarks </h3>'
                   || CASE WHEN page_id % 3 = 0 THEN '<p>We saw total revenues of $' || cast(page_id AS string)
                        || ' billion.</p>' ELSE '' END) AS html,
               html AS source_html
        FROM {pages}""",
    # hits: forty pages share one company and quarter, as two searches of twenty hits
    "f_hit": """
        SELECT 'C' || lpad(cast(cast(floor(page_id / 40) AS bigint) AS string), 9, '0') AS ticker, 2001 AS year,
               cast(floor(page_id / 40) AS bigint) % 4 + 1 AS q,
               CASE WHEN page_id % 40 < 20 THEN 1 ELSE 2 END AS query_no, page_id % 20 + 1 AS rank,
               url || CASE WHEN page_id % 3 = 0
                   THEN '/Q' || cast(cast(floor(page_id / 40) AS bigint) % 4 + 1 AS string) || '-2001-call'
                   ELSE '' END AS href,
               CASE WHEN page_id % 4 = 0
                    THEN 'q' || cast(cast(floor(page_id / 40) AS bigint) % 4 + 1 AS string) || ' 2001 results'
                    WHEN page_id % 4 = 1 THEN NULL ELSE 'Other' END AS title,
               url AS page_url, CASE WHEN page_id % 11 = 5 THEN NULL ELSE html END AS body
        FROM {pages}""",
    # replies: fenced, bare, broken, empty, an array, one with nulls and missing keys, three with closing remarks
    "f_reply": """
        SELECT doc_id, 'Q' || cast(doc_id % 4 + 1 AS string) || ' 2001' AS label,
               CASE doc_id % 9
                   WHEN 6 THEN body || ' Note: from the call.'
                   WHEN 7 THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Let me know.'
                   WHEN 8 THEN '[' || news || '] hope it helps'
                   WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                   WHEN 1 THEN body
                   WHEN 2 THEN substr(body, 2)
                   WHEN 3 THEN ''
                   WHEN 4 THEN '[' || news || ', ' || news || ']'
                   ELSE '{{"date": null, "tone": null, "key_themes": ["' || lang || '"], "financials": {{"n": '
                        || cast(n_chars AS string) || '}}}}' END AS reply
        FROM (SELECT doc_id, lang, n_chars,
                '{{"quarter": "Q9 2001", "date": "2001-05-0' || cast(doc_id % 9 + 1 AS string) || '", "speakers": ["'
                || source || ' (CEO)"], "key_themes": ["' || lang || '", "growth"], "risks": [], "tone": "calm",'
                || ' "key_quotes": [{{"speaker": "' || source || '", "theme": "text", "text": "' ||
                replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)),
                chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')
                || '"}}], "financials": {{"revenue_bn": ' || cast(n_chars AS string) || '.5, "beat": true,'
                || ' "note": "ok", "eps": null}}, "data_quality": "high"}}' AS body,
                '{{"date": "2001-02-03", "source": "' || source || '", "headline": "Doc ' || cast(doc_id AS string)
                || '", "snippet": "' || lang || '", "tags": ["' || lang || '", "x"]}}' AS news
              FROM {documents}) d""",
    "f_turn": """
        SELECT conv_id, turn, role, text FROM {conversations}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needed(name: str) -> list[str]:
    """A view and the views under it, in the order they have to be defined."""
    order = []
    for under in _NAME.findall(VIEWS.get(name, "")):
        order += [n for n in needed(under) if n not in order]
    return order + [name] if name in VIEWS else order


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or a view over it."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    under = {n: table(spark, folder, n) for n in set(_NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **under)


def with_views(sql: str) -> str:
    """A counterpart SELECT over ``{views}`` as one statement for DuckDB."""
    order = []
    for name in _NAME.findall(sql):
        order += [n for n in needed(name) if n not in order]
    fill = {n: n for n in [*VIEWS, *TABLES]}
    parts = [f"{n} AS ({VIEWS[n].format(**fill)})" for n in order]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    body = sql.format(**fill).strip()
    if head and body.upper().startswith("WITH "):
        return head.rstrip() + ",\n" + body[5:]
    return head + body
