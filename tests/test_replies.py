import json
import re

from pyspark.sql import functions as F

from quarterdeck import fixed_values as V
from quarterdeck.functions import replies as R
from quarterdeck.operators import extraction as E

GOOD = {"quarter": "Q3 2024", "date": "2024-10-01", "speakers": ["A (CEO)"], "key_themes": ["t"], "risks": [],
        "key_quotes": [{"speaker": "A", "theme": "x", "text": "é \"q\""}], "tone": "calm",
        "financials": {"revenue_bn": 1.5, "n": 3, "ok": True, "note": "x", "none": None}}


def frame(spark, replies):
    return spark.createDataFrame([(i, "Q1 2024", r) for i, r in enumerate(replies)], "i int, label string, reply string")


def parsed(spark, replies, tier=2):
    return [r.asDict(True) for r in E.parse_quarter_replies(frame(spark, replies), tier=tier).orderBy("i").collect()]


def test_fences(spark):
    raws = ["```json\n{}\n```", "```\n[1]```  ", "{}", "a\n```json\nb\n```\nc", "", "  ```json {}"]
    out = [r.o for r in frame(spark, raws).select("i", R.strip_fences(F.col("reply")).alias("o")).orderBy("i").collect()]
    strip = lambda t: re.sub(V.FENCE_CLOSE, "", re.sub(V.FENCE_OPEN, "", t, flags=re.M), flags=re.M).strip()
    assert out == [strip(r) for r in raws]


def test_good_reply(spark):
    row = parsed(spark, ["```json\n" + json.dumps(GOOD) + "\n```"])[0]
    p = row["parsed"]
    assert row["parse_ok"] and p["quarter"] == "Q3 2024" and p["key_quotes"][0]["text"] == 'é "q"'
    assert p["financials"] == {"revenue_bn": "1.5", "n": "3", "ok": "true", "note": "x", "none": None}


def test_fallbacks(spark):
    for reply in ("", "not json", "{\"a\": 1", "[{}]", "3", "null", "\"text\""):
        low, plain = parsed(spark, [reply], 1)[0], parsed(spark, [reply], 2)[0]
        assert not low["parse_ok"] and not plain["parse_ok"]
        assert low["parsed"]["quarter"] == plain["parsed"]["quarter"] == "Q1 2024"
        assert low["parsed"]["data_quality"] == "low" and low["parsed"]["error"] == "LLM parse failed"
        assert plain["parsed"]["data_quality"] is None and plain["parsed"]["error"] is None
        assert plain["parsed"]["speakers"] == [] and plain["parsed"]["date"] is None


def test_missing_and_null_keys_differ(spark):
    missing, null = parsed(spark, ["{}", json.dumps(dict.fromkeys(GOOD))])
    assert missing["parsed"]["quarter"] == "Q1 2024" and missing["parsed"]["key_themes"] == []
    assert null["parsed"]["quarter"] is None and null["parsed"]["key_themes"] is None
    assert not missing["has_speakers"] and null["has_speakers"]


def test_assembled_record(spark):
    replies = [json.dumps(GOOD), "{}", json.dumps({"date": "", "speakers": None}), "broken"]
    rows = E.parse_quarter_replies(frame(spark, replies)).select(
        "*", F.lit("2024-12-31").alias("call_date"), F.array(F.lit("Page")).alias("page_speakers"),
        F.lit("u").alias("url"),
    )
    ours = [(r.record.date, r.record.speakers, r.record.source_url)
            for r in E.assemble_quarters(rows).orderBy("i").collect()]
    assert ours == [("2024-10-01", ["A (CEO)"], "u"), ("2024-12-31", ["Page"], "u"), ("2024-12-31", None, "u"),
                    ("2024-12-31", [], "u")]


def test_news_must_be_an_array(spark):
    item = {"date": None, "source": "s", "headline": "h", "snippet": "n", "tags": ["a"]}
    rows = E.parse_news_replies(frame(spark, [json.dumps([item, item]), json.dumps(item), "x", ""]))
    assert [len(r.news) for r in rows.orderBy("i").collect()] == [2, 0, 0, 0]


def test_only_whole_replies_count(spark):
    """Anything beside the one value is an error, as are a repeated key and a bare NaN."""
    bad = ['{"a": 1} Note: from the call.', '```json\n{"a": 1}\n```\nLet me know.', '{"a": 1}] x', '{"a": 1},{"b": 2}', '{"a": 1}, "k": {"b": 2}',
           '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1', '']
    good = ['{"a": "x \\"y\\" \\\\ \\n"}', ' {"a": {"b": [1, 2]}} ', '```json\n{"a": 1}\n```']
    rows = frame(spark, bad + good).orderBy("i").select(R.as_object(F.col("reply")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [False] * len(bad) + [True] * len(good)


def test_figures_replies(spark):
    rows = E.parse_figures_replies(frame(spark, ['{"revenue_bn": 2.5, "eps_estimate": null}', "[]", ""]))
    assert [r.financials for r in rows.orderBy("i").collect()] == [{"revenue_bn": "2.5", "eps_estimate": None}, {}, {}]


def test_figures_json_is_as_printed_by_python(spark):
    cases = [
        {"revenue_bn": 44.1, "n": 122, "flag": True, "text": 'all-time "high" — é😀', "none": None}, {}, {"a\\b": 1},
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, t string").select(
        "i", F.from_json("t", "map<string,string>").alias("m")
    )
    spelled = spark.sql("SELECT map('a', '0.50', 'b', '1E3', 'c', 'NaN', 'd', '4680d', 'e', '-7') AS m")
    assert json.loads(spelled.select(R.figures_json(F.col("m"))).first()[0]) == {
        "a": 0.5, "b": 1000.0, "c": "NaN", "d": "4680d", "e": -7}
    assert '"a": 0.5,' in spelled.select(R.figures_json(F.col("m"))).first()[0]
    ours = [r.o for r in rows.select("i", R.figures_json(F.col("m")).alias("o")).orderBy("i").collect()]
    assert ours == [json.dumps(c, indent=2) for c in cases]


def test_search_filter(spark):
    rows = spark.createDataFrame([("a", "text"), ("b", " \n"), ("c", "x [Search failed: y]"), ("d", "")],
                                 "k string, snippets string")
    assert [r.k for r in E.keep_searched(rows).collect()] == ["a"]
