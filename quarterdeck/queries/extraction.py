"""Queries on model replies."""

from pyspark.sql import functions as F

from quarterdeck.functions import replies as R
from quarterdeck.operators import extraction as E
from quarterdeck.queries.registry import query, strip
from quarterdeck.queries.views import table

CLEAN_SQL = strip(r"regexp_replace(regexp_replace(reply, '(?m)^```(?:json)?\s*', '', 'g'), '(?m)\s*```$', '', 'g')")
PARSED_SQL = f"""
    clean AS (SELECT *, {CLEAN_SQL} AS body FROM {{f_reply}}),
    typed AS (SELECT *, CASE WHEN json_valid(body) AND body <> '' THEN json_type(body) END AS kind FROM clean),
    objects AS (SELECT *, CASE WHEN kind = 'OBJECT' THEN body::json END AS o,
                CASE WHEN kind = 'ARRAY' THEN body::json END AS a FROM typed)"""


@query(f"SELECT doc_id, {CLEAN_SQL} AS body FROM {{f_reply}}")
def replies_clean(spark, folder):
    return table(spark, folder, "f_reply").select("doc_id", R.strip_fences(F.col("reply")).alias("body"))


QUARTER_SQL = """
    doc_id, cast(o IS NOT NULL AS string) AS parse_ok,
    coalesce(o->>'$.quarter', label) AS quarter, o->>'$.date' AS date,
    coalesce(array_to_string(cast(o->'$.speakers' AS string[]), '; '), '') AS speakers,
    coalesce(array_to_string(cast(o->'$.key_themes' AS string[]), '; '), '') AS themes,
    coalesce(o->>'$.key_quotes[0].text', '') AS quote, o->>'$.tone' AS tone"""


def _shown(parsed):
    p = F.col("parsed")
    return [
        "doc_id", F.col("parse_ok").cast("string").alias("parse_ok"), p["quarter"].alias("quarter"),
        p["date"].alias("date"), F.array_join(p["speakers"], "; ").alias("speakers"),
        F.array_join(p["key_themes"], "; ").alias("themes"),
        F.coalesce(F.get(p["key_quotes"], F.lit(0))["text"], F.lit("")).alias("quote"), p["tone"].alias("tone"),
    ]


@query("WITH " + PARSED_SQL + f"""
    SELECT {QUARTER_SQL}, CASE WHEN o IS NULL THEN 'low' ELSE o->>'$.data_quality' END AS data_quality,
           CASE WHEN o IS NULL THEN 'LLM parse failed' END AS error,
           coalesce(array_to_string(cast(o->'$.risks' AS string[]), '; '), '') AS risks,
           coalesce(array_to_string(list_transform(cast(o->'$.key_quotes' AS json[]),
               lambda q: concat_ws('|', q->>'$.speaker', q->>'$.theme', q->>'$.text')), '; '), '') AS quotes,
           coalesce(array_to_string(list_sort(list_transform(json_keys(o, '$.financials'),
               lambda k: k || '=' || coalesce(o->'$.financials'->>k, 'none'))), '; '), '') AS figures
    FROM objects""")
def replies_quarter(spark, folder):
    """Replies of the snippet kind, with fallback records for those that cannot be read."""
    parsed = E.parse_quarter_replies(table(spark, folder, "f_reply"), "label", tier=1)
    p = F.col("parsed")
    quotes = F.transform(p["key_quotes"], lambda q: F.concat_ws("|", q["speaker"], q["theme"], q["text"]))
    figures = F.transform(
        F.map_entries(p["financials"]), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("none")))
    )
    return parsed.select(
        *_shown(parsed), p["data_quality"].alias("data_quality"), p["error"].alias("error"),
        F.array_join(p["risks"], "; ").alias("risks"), F.array_join(quotes, "; ").alias("quotes"),
        F.array_join(F.array_sort(figures), "; ").alias("figures"),
    )


@query("WITH " + PARSED_SQL + """
    SELECT doc_id, i - 1 AS item_pos, n->>'$.date' AS date, n->>'$.source' AS source, n->>'$.headline' AS headline,
           n->>'$.snippet' AS snippet, array_to_string(cast(n->'$.tags' AS string[]), '|') AS tags
    FROM (SELECT doc_id, unnest(cast(a AS json[])) AS n, generate_subscripts(cast(a AS json[]), 1) AS i
          FROM objects WHERE a IS NOT NULL) x""")
def replies_news(spark, folder):
    news = E.parse_news_replies(table(spark, folder, "f_reply"))
    return news.select("doc_id", F.posexplode("news").alias("item_pos", "n")).select(
        "doc_id", F.col("item_pos").cast("long").alias("item_pos"), "n.date", "n.source", "n.headline", "n.snippet",
        F.array_join("n.tags", "|").alias("tags"),
    )


@query("WITH " + PARSED_SQL + """
    , f AS (SELECT doc_id, CASE WHEN o IS NULL THEN '{{}}'::json ELSE coalesce(o->'$.financials', '{{}}'::json) END AS f
            FROM objects)
    SELECT doc_id, key AS name, f->>key AS value FROM (SELECT doc_id, f, unnest(json_keys(f)) AS key FROM f) k""")
def replies_financials(spark, folder):
    """The figures inside each reply, asked for as an object of their own."""
    replies = table(spark, folder, "f_reply")
    part = F.coalesce(F.get_json_object(R.strip_fences(F.col("reply")), "$.financials"), F.lit(""))
    # only whole replies count: a broken one must not yield its readable end
    asked = replies.withColumn("reply", F.when(R.as_object(F.col("reply")).isNotNull(), part).otherwise(F.lit("")))
    figures = E.parse_figures_replies(asked)
    return figures.select("doc_id", F.explode("financials").alias("name", "value"))


MERGED_SQL = PARSED_SQL + """,
    merged AS (SELECT r.*, f.o AS figures FROM objects r LEFT JOIN objects f
               ON f.doc_id = r.doc_id + CASE WHEN r.doc_id % 2 = 0 THEN 1 ELSE -1 END)"""


def _merged(spark, folder):
    """Each reply as a quarter, with the figures of its neighbour's reply."""
    replies = table(spark, folder, "f_reply")
    no = F.col("doc_id")
    neighbour = no + F.when(no % 2 == 0, 1).otherwise(-1)
    figures = E.parse_figures_replies(replies).select(neighbour.alias("doc_id"), "financials")
    parsed = E.parse_quarter_replies(replies, "label", tier=2)
    return E.merge_financials(parsed, figures, ["doc_id"])


@query("WITH " + MERGED_SQL + f"""
    SELECT {QUARTER_SQL}, coalesce(figures->>'$.tone', 'none') AS figure_tone, coalesce(len(json_keys(figures)), 0)
           AS n_figures FROM merged""")
def merged_quarters(spark, folder):
    merged = _merged(spark, folder)
    financials = F.col("parsed.financials")
    return merged.select(
        *_shown(merged), F.coalesce(F.try_element_at(financials, F.lit("tone")), F.lit("none")).alias("figure_tone"),
        F.size(financials).cast("long").alias("n_figures"),
    )


def _assembled(spark, folder):
    no = F.col("doc_id")
    merged = _merged(spark, folder).select(
        "*", F.concat(F.lit("http://x/"), no.cast("string")).alias("url"),
        F.when(no % 2 == 0, F.lit("2001-12-31")).alias("call_date"),
        F.array(F.lit("Page Speaker")).alias("page_speakers"), no.cast("string").alias("ticker"),
    )
    return E.assemble_quarters(merged)


SPEAKERS_SQL = """CASE WHEN o IS NULL THEN [] WHEN (o->'$.speakers') IS NULL THEN ['Page Speaker']
    ELSE cast(o->'$.speakers' AS string[]) END"""


@query("WITH " + PARSED_SQL + f"""
    SELECT doc_id, coalesce(nullif(o->>'$.date', ''), CASE WHEN doc_id % 2 = 0 THEN '2001-12-31' END) AS date,
           array_to_string({SPEAKERS_SQL}, '; ') AS speakers, 'http://x/' || doc_id AS source_url FROM objects""")
def assembled_quarters(spark, folder):
    r = F.col("record")
    return _assembled(spark, folder).select(
        "doc_id", r["date"].alias("date"), F.array_join(r["speakers"], "; ").alias("speakers"),
        r["source_url"].alias("source_url"),
    )


@query("WITH " + PARSED_SQL + f"""
    SELECT cast(doc_id AS string) AS ticker, label, coalesce(json_array_length(o->'$.key_quotes'), 0)::bigint AS n_quotes,
           coalesce(json_array_length(o->'$.key_themes'), 0)::bigint AS n_themes, len({SPEAKERS_SQL}) AS n_speakers,
           length(reply) AS n_chars, coalesce(o->>'$.data_quality', '?') AS data_quality FROM objects""")
def extraction_stats(spark, folder):
    return E.extraction_stats(_assembled(spark, folder), "reply")
