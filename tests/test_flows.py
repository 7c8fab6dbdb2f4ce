"""Completion, whole flows, writers and readers."""

import datetime as dt
import json
import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarterdeck import schemas as S
from quarterdeck.operators import briefs as B
from quarterdeck.operators import catalog as C
from quarterdeck.operators import filings as FL
from quarterdeck.operators.completion import complete, complete_stored, run_stats, stored_replies
from quarterdeck.operators.shared import settled
from quarterdeck.plans.brief import brief_companies
from quarterdeck.operators import calls as CA
from quarterdeck.plans.filings import registry_updates, seed_companies
from quarterdeck.plans.pages import pages_to_documents, snippets_to_documents
from quarterdeck.sinks import files
from quarterdeck.sinks import registry as RG
from quarterdeck.sinks.named_files import write_named
from quarterdeck.sources import documents as D
from quarterdeck.sources import tables as ST
# the stand-in models below are sent to the tasks, which cannot import a test file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def as_of():
    return F.lit("2024-07-15").cast("date")


def test_completion_retries_and_then_gives_an_empty_reply(spark, tmp_path):
    log = str(tmp_path)

    def fn(system, user):
        import os
        import uuid
        open(os.path.join(log, f"{user}-{uuid.uuid4()}"), "w").close()
        tries = len([f for f in os.listdir(log) if f.startswith(user)])
        if user == "never" or (user == "second" and tries < 2):
            raise RuntimeError("busy")
        return None if user == "none" else (system + user, 5, 7)

    rows = [("k1", "l", "s", "first"), ("k2", "l", "s", "second"), ("k3", "l", "s", "never"), ("k4", "m", "s", "none")]
    prompts = spark.createDataFrame(rows, "key string, label string, system string, user string").coalesce(1)
    replies = settled(complete(prompts, fn, wait=0, parallelism=2), str(tmp_path / "replies"))
    got = {r.key: (r.reply, r.attempts, r.tokens_in, r.result_chars) for r in replies.collect()}
    assert got == {"k1": ("sfirst", 1, 5, 6), "k2": ("ssecond", 2, 5, 7), "k3": ("", 3, 0, 0), "k4": ("", 1, 0, 0)}
    stats = {r.label: (r.calls, r.empty_replies, r.tokens_out, r.longest_result) for r in run_stats(replies).collect()}
    assert stats == {"l": (3, 1, 14, 7), "m": (1, 1, 0, 0)}


def page(body):
    return f'<html><article class="article-body">{body}</article></html>'


def model(system, user):
    """Answers by the kind of prompt, with what the prompt has."""
    label = user.split("Quarter: ")[1].split("\n")[0] if "Quarter: " in user else ""
    if "revenue in billions" in user:
        return '```json\n{"revenue_bn": 2.5}\n```'
    if "news items" in user:
        return json.dumps([{"date": None, "source": "s", "headline": user.split("TITLE:  ")[1][:2], "snippet": "n",
                            "tags": ["t"]}]) if "TITLE" in user else "[]"
    if label == "Q1 2024":
        return "no json"
    return json.dumps({"quarter": label, "date": "", "key_themes": ["one"], "tone": "calm"})


def companies(spark):
    return spark.createDataFrame([("AAA", "Alpha", "Tech", "Chips"), ("BBB", "Beta", "Food", "Milk")],
                                 "ticker string, company string, sector string, industry string")


def test_pages_to_documents(spark):
    text = "<p>DATE Tuesday, May 7, 2024</p><p>Jane Doe -- CEO speaks.</p><p>" + "word " * 200 + "</p>"
    pages = spark.createDataFrame(
        [("https://www.fool.com/1", page(text)), ("https://www.fool.com/2", page(text)),
         ("https://www.fool.com/3", page("<p>short</p>")), ("https://www.fool.com/4", None),
         ("https://www.fool.com/unused", page(text))], "url string, html string")
    hits = spark.createDataFrame(
        [("AAA", 2024, 2, 1, 1, "https://www.fool.com/1", "Q2 2024"), ("AAA", 2024, 1, 2, 3, "https://www.fool.com/2", "q1 2024"),
         ("AAA", 2023, 4, 1, 1, "https://www.fool.com/3", "q4 2023"), ("BBB", 2024, 2, 1, 1, "https://www.fool.com/4", "q2 2024")],
        "ticker string, year int, q int, query_no int, rank int, href string, title string")
    docs = {d.ticker: d for d in pages_to_documents(companies(spark), hits, pages, model, as_of(), 4, wait=0).collect()}
    first, second = docs["AAA"].transcripts
    assert (first.quarter, first.date, first.speakers, first.financials, first.tone, first.source_url) == (
        "Q2 2024", "2024-05-07", ["Jane Doe"], {"revenue_bn": "2.5"}, "calm", "https://www.fool.com/1")
    assert (second.quarter, second.date, second.speakers, second.key_themes) == ("Q1 2024", "2024-05-07", [], [])
    assert docs["BBB"].transcripts == [] and docs["BBB"].news is None
    assert docs["AAA"].last_updated == "2024-07-15"


def test_snippets_to_documents(spark):
    hits = spark.createDataFrame(
        [("AAA", 2024, 2, 1, "h", "t1", "b"), ("AAA", 2024, 1, 1, "h", "t2", None), ("AAA", 2023, 4, 1, "h", "t3", "[Search failed: x]")],
        "ticker string, year int, q int, rank int, href string, title string, body string")
    news = spark.createDataFrame([("BBB", 1, "h", "n1", "b")], "ticker string, rank int, href string, title string, body string")
    made = snippets_to_documents(
        companies(spark), hits, news, model, as_of(), 4, fetcher=C.fetcher_block(1, "search", "none", "note"), wait=0)
    docs = {d.ticker: d for d in made.collect()}
    a, b = docs["AAA"], docs["BBB"]
    assert [(t.quarter, t.data_quality, t.error) for t in a.transcripts] == [
        ("Q2 2024", None, None), ("Q1 2024", "low", "LLM parse failed")]
    assert a.news == [] and [n.headline for n in b.news] == ["n1"] and b.transcripts == []
    assert a.industry == "Chips" and a.fetcher.tier == 1


def seeded(spark):
    filings = spark.createDataFrame(
        [("AAA", "1", "10-Q", dt.date(2024, 5, 1), dt.date(2024, 3, 31), None),
         ("AAA", "2", "10-Q", dt.date(2024, 8, 1), dt.date(2024, 6, 30), None),
         ("AAA", "3", "8-K", dt.date(2024, 8, 1), None, "2.02")],
        "ticker string, accession string, form string, filing_date date, period_of_report date, items string")
    facts = spark.createDataFrame([("2", 0, "Revenue", False, None, "2024-06-30", 0, 5.04e9)], S.FACT)
    return seed_companies(companies(spark), filings, facts, last_updated=as_of())


def test_seeded_companies_and_updates(spark):
    docs = seeded(spark)
    by = {d.ticker: d for d in docs.collect()}
    assert [(t.quarter, t.financials["revenue_bn"]) for t in by["AAA"].transcripts] == [("Q1 2024", None), ("Q2 2024", "5.0")]
    assert by["BBB"].transcripts == by["BBB"].news == by["BBB"].annual_filings == []
    updates = {r.ticker: (r.transcript_count, r.news_items) for r in registry_updates(docs, F.lit(1)).collect()}
    assert updates == {"AAA": (2, 1), "BBB": (0, 0)}


def test_brief_calls_the_model_three_times(spark, tmp_path):
    log = str(tmp_path)

    def fn(system, user):
        import os
        import uuid
        open(os.path.join(log, str(uuid.uuid4())), "w").close()
        return f"[{len(user)}]"

    made = brief_companies(seeded(spark), fn, F.lit("2024-07-15 01:02:03").cast("timestamp"), settle=settled, wait=0)
    rows = made.collect()
    assert len(rows) == 1 and len(list(tmp_path.iterdir())) == 3  # BBB has no quarter and is not asked about
    brief = rows[0]
    assert (brief.company, brief.quarter, brief.previous_quarter) == ("Alpha", "Q2 2024", "Q1 2024")
    assert brief.memo_file == "AAA_memo_20240715_010203.md" and brief.elapsed_seconds == 0.0
    assert set(made.columns) == {
        "company", "ticker", "quarter", "previous_quarter", "earnings_analysis", "sentiment_analysis", "memo",
        "memo_file", "elapsed_seconds"}


def test_prompt_texts(spark):
    quarter = {"quarter": "Q2", "date": None, "speakers": ["A", "B"], "financials": {}, "key_quotes": [
        {"speaker": "A", "theme": "t", "text": "x"}], "key_themes": ["k"], "risks": ["r"], "tone": "calm"}
    rows = spark.createDataFrame([("T", quarter, None), ("U", quarter, quarter)],
                                 f"ticker string, current {S.QUARTER.simpleString()}, previous {S.QUARTER.simpleString()}")
    alone, both = [r.user for r in B.earnings_prompts(rows).orderBy("ticker").collect()]
    assert alone == (
        "## Current Quarter: Q2 (N/A)\n\n**Speakers:** A, B\n\n**Financials:** {}\n\n**Tone:** calm\n\n"
        '**Key Themes:**\n- k\n\n**Key Quotes:**\n- A (t): "x"\n\n**Risks:**\n- r\n')
    assert both == alone + (
        "\n---\n\n## Previous Quarter: Q2 (N/A)\n\n**Financials:** {}\n\n**Tone:** calm\n\n"
        '**Key Themes:**\n- k\n\n**Risks:**\n- r\n\n**Key Quotes:**\n- A (t): "x"\n')


def test_documents_round_trip(spark, tmp_path):
    docs = seeded(spark)
    path = str(tmp_path / "json")
    files.write_companies(docs, path)
    read = D.read_companies(spark, path + "/*.json")
    plain = [c for c in docs.columns if c != "fetcher"]
    ours = {r.ticker: r.asDict(True) for r in read.select(*plain).collect()}
    theirs = {r.ticker: r.asDict(True) for r in docs.select(*plain).collect()}
    assert set(ours) == set(theirs) and all(
        [q["quarter"] for q in ours[t]["transcripts"]] == [q["quarter"] for q in theirs[t]["transcripts"]] for t in ours)
    assert ours["AAA"]["news"] == theirs["AAA"]["news"]
    # what was written can be looked up, also after the registry has been written back
    entries = [(0, "Alpha", "AAA", "aaa.json")]
    registry = spark.createDataFrame(entries, "pos long, name string, ticker string, file string").select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.REGISTRY_ENTRY.fields if f.name not in ("name", "ticker", "file")])
    assert [r.ticker for r in C.company_document(registry, read, "alpha").collect()] == ["AAA"]
    update = spark.createDataFrame([("BBB", "Beta", 1, 0, 1)], "ticker string, name string, transcript_count long, news_items long, update_no long")
    files.write_registry(C.upsert_registry(registry, update), str(tmp_path / "registry"))
    again = D.read_registry(spark, str(tmp_path / "registry"))
    assert [(r.pos, r.ticker) for r in again.orderBy("pos").collect()] == [(0, "AAA"), (1, "BBB")]
    assert [r.ticker for r in C.company_document(again, read, "beta").collect()] == ["BBB"]
    assert C.registered(again, read).count() == 2
    again_registry = again
    # writing one company again replaces it alone
    files.write_companies(docs.filter("ticker = 'AAA'").withColumn("sector", F.lit("New")), path)
    again = {r.ticker: r.sector for r in D.read_companies(spark, path + "/*.json").collect()}
    assert again == {"AAA": "New", "BBB": "Food"}
    files.write_company_table(docs, str(tmp_path / "table"))
    table = D.read_company_table(spark, str(tmp_path / "table"))
    assert table.count() == 2
    # a lookup in the table is pruned to one folder
    one = C.company_document(again_registry, table, "beta")
    assert [r.ticker for r in one.collect()] == ["BBB"]
    assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(p.name for p in (tmp_path / "json").iterdir()) == ["aaa.json", "bbb.json"]
    assert json.loads((tmp_path / "json" / "bbb.json").read_text())["ticker"] == "BBB"


def test_registry_and_foreign_files(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"companies": [
        {"name": "Alpha", "ticker": "AAA", "file": "aaa.json", "transcript_count": 2},
        {"name": "Beta", "ticker": "BBB", "file": "bbb.json"}]}))
    (tmp_path / "aaa.json").write_text(json.dumps({"company": "Alpha", "ticker": "AAA", "transcripts": [
        {"quarter": "Q1 2024", "financials": {"n": 122, "x": 7.8, "f": True, "t": "high", "z": None}}]}, indent=1))
    registry = D.read_registry(spark, str(tmp_path / "index.json"))
    assert [(r.pos, r.name, r.transcript_count) for r in registry.collect()] == [(0, "Alpha", 2), (1, "Beta", None)]
    docs = D.read_companies(spark, str(tmp_path))
    assert [(r.file, r.ticker) for r in docs.select("file", "ticker").collect()] == [("aaa.json", "AAA")]
    assert docs.first().transcripts[0].financials == {"n": "122", "x": "7.8", "f": "true", "t": "high", "z": None}
    assert C.company_detail(registry, docs).first().transcript_count == 1


def test_raw_transcripts_and_memos_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(
        [{"company": "Alpha", "ticker": "AAA", "year": 2024, "quarter": q, "full_text": f"t{q}", "speakers": ["A"],
          "fetched_at": dt.datetime(2024, 1, 1), "key_numbers": {"eps_mentioned": "$1"}} for q in (1, 2)],
        S.RAW_TRANSCRIPT)
    files.write_raw_transcripts(raw, str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw" / "aaa").iterdir()) == ["Q1_2024.json", "Q2_2024.json"]
    read = D.read_raw_transcripts(spark, str(tmp_path / "raw" / "*" / "*"))
    assert sorted((r.ticker, r.year, r.quarter, r.full_text) for r in read.collect()) == [
        ("AAA", 2024, 1, "t1"), ("AAA", 2024, 2, "t2")]
    index = CA.transcript_index(read)
    files.write_transcript_index(index, str(tmp_path / "raw"))
    entry = json.loads((tmp_path / "raw" / "aaa" / "_index.json").read_text())
    assert (entry["total_transcripts"], [t["file"] for t in entry["transcripts"]]) == (2, ["Q1_2024.json", "Q2_2024.json"])
    assert D.read_raw_transcripts(spark, str(tmp_path / "raw" / "*")).count() == 2  # the index is no call
    memos = spark.createDataFrame([("AAA", "AAA_memo_1.md", "# Memo\n\ntext"), ("BBB", "BBB_memo_1.md", "x")],
                                  "ticker string, memo_file string, memo string")
    files.write_memos(memos, str(tmp_path / "memos"))
    back = D.read_memos(spark, str(tmp_path / "memos"))
    assert sorted((r.ticker, r.memo_file, r.memo.rstrip("\n")) for r in back.collect()) == sorted(
        tuple(r) for r in memos.collect())


def test_named_files_of_a_failing_job_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "named")
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.txt", str(k)) for k in range(20)], "file string, content string")
    write_named(rows, path)
    assert {str(p.relative_to(path)): p.read_text() for p in (tmp_path / "named").rglob("*.txt")} == {f"d{k % 3}/f{k}.txt": str(k) for k in range(20)}
    for bad in ([("new.txt", "x"), ("same.txt", "1"), ("same.txt", "2")], [("new.txt", "x"), ("../out.txt", "1")]):
        with pytest.raises(Exception, match="two rows|no name"):
            write_named(spark.createDataFrame(bad, "file string, content string"), path)
    assert not (tmp_path / "named" / "new.txt").exists() and sorted(p.name for p in (tmp_path / "named").iterdir()) == ["d0", "d1", "d2"]


def test_registry_versions(spark, tmp_path):
    address = str(tmp_path / "registry")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.REGISTRY_ENTRY.fields)
    rest = ("", [], 0, 0, None, [])
    entries = spark.createDataFrame([(k, f"N{k}", f"T{k}", f"t{k}.json", *rest) for k in range(50)], f"pos long, {kinds}")
    assert RG.commit_registry(entries, address) == 1
    updates = spark.createDataFrame([("T3", "New 3", 1, 0, 1), ("Z", "Zed", 1, 0, 2), ("Y", "Why", 1, 0, 1)],
                                    "ticker string, name string, transcript_count long, news_items long, update_no long")
    assert RG.commit_registry(C.upsert_registry(RG.read_registry_version(spark, address), updates), address) == 2
    after = [(r.pos, r.name) for r in RG.read_registry_version(spark, address).orderBy("pos").collect()]
    assert after == [(k, "New 3" if k == 3 else f"N{k}") for k in range(50)] + [(50, "Why"), (51, "Zed")]
    # a writer that fails, and one that comes too late, change nothing
    broken = RG.read_registry_version(spark, address).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    for failing in (lambda: RG.commit_registry(broken, address), lambda: RG.commit_registry(entries, address, after=1)):
        with pytest.raises(Exception):
            failing()
    assert RG.registry_versions(spark, address) == [1, 2] and sorted(p.name for p in (tmp_path / "registry").iterdir()) == ["version-00000001", "version-00000002"]
    assert [(r.pos, r.name) for r in RG.read_registry_version(spark, address, 1).orderBy("pos").collect()] == [(k, f"N{k}") for k in range(50)]


def test_a_run_that_stops_asks_only_for_the_rest(spark, tmp_path):
    """Tasks that ended before the job failed keep their replies; equal prompts are asked once."""
    store, asked = str(tmp_path / "store"), tmp_path / "asked"
    asked.mkdir()
    prompts = spark.createDataFrame([(k, "l", "s", f"u{k % 30}") for k in range(60)], "k int, label string, system string, user string")

    def fn(system, user):
        (asked / f"{user}-{uuid.uuid4().hex}").touch()
        if user == "u7" and not (asked / "mended").exists():
            time.sleep(3)  # others end meanwhile
            os._exit(1)
        return user.upper(), 1, 1

    with pytest.raises(Exception):
        complete_stored(prompts, fn, store, parts=30, wait=0)
    kept = {r.reply for r in stored_replies(spark, store).collect()}
    assert 0 < len(kept) < 30
    (asked / "mended").touch()
    before = len(list(asked.iterdir()))
    rows = complete_stored(prompts, fn, store, parts=30, wait=0).collect()
    assert sorted((r.k, r.reply, r.result_chars) for r in rows) == [(k, f"U{k % 30}", len(f"U{k % 30}")) for k in range(60)]
    assert len(list(asked.iterdir())) - before == 30 - len(kept)
    complete_stored(prompts, fn, store, parts=30, wait=0)
    assert len(list(asked.iterdir())) - before == 30 - len(kept)


def test_failed_prompts_are_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "l", "s", "a"), (2, "l", None, "b")], "k int, label string, system string, user string")

    def fails(system, user):
        raise ValueError("no")

    first = complete_stored(prompts, fails, str(tmp_path / "store"), parts=2, max_retries=0, wait=0).collect()
    assert [(r.reply, r.attempts) for r in first] == [("", 1), ("", 1)]
    again = complete_stored(prompts, lambda s, u: u * 2, str(tmp_path / "store"), parts=2, wait=0).collect()
    assert sorted((r.k, r.reply) for r in again) == [(1, "aa"), (2, "bb")]


def test_briefs_need_a_way_to_settle(spark):
    with pytest.raises(ValueError, match="settle or store"):
        brief_companies(seeded(spark), lambda s, u: u, F.lit("2024-07-15 01:02:03").cast("timestamp"))


def test_stored_briefs(spark, tmp_path):
    """With a store of replies, briefs that are made again ask nothing."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(system, user):
        (calls / uuid.uuid4().hex).touch()
        return f"{len(user)}"

    at = F.lit("2024-07-15 01:02:03").cast("timestamp")
    made = [brief_companies(seeded(spark), fn, at, store=str(tmp_path / "store"), wait=0, parts=2).drop("elapsed_seconds").collect() for _ in range(2)]
    assert sorted(made[0]) == sorted(made[1]) and len(list(calls.iterdir())) == 3 * len(made[0])


def test_statements_keep_the_periods_of_their_filing(spark):
    records = [("A", 0, '{"label": "Revenue", "2024-12-31": 9e9, "2023-12-31": null, "abstract": false}'),
               ("B", 0, '{"label": "Revenue", "units": "USD", "2024-09-30": "7e9", "abstract": true, "dimension": "Segment"}'),
               ("C", 0, '{"label": "Revenue"}'), ("D", 0, "no json"), ("E", 0, None)]
    read = ST.read_statements(spark.createDataFrame(records, "accession string, ord int, record string"))
    first = {r.accession: (r.period, r.val, r.abstract, r.dim) for r in ST.statement_first_period(read).collect()}
    assert first == {"A": ("2024-12-31", 9e9, False, None), "B": ("2024-09-30", 7e9, True, "Segment")}
    assert sorted((r.accession, r.period, r.period_pos, r.val) for r in ST.statement_facts(read).collect() if r.val) == [
        ("A", "2024-12-31", 0, 9e9), ("B", "2024-09-30", 0, 7e9)]
    wide = spark.createDataFrame([("A", 0, "Revenue", False, None, 9e9, None), ("A", 1, "Net income", False, None, None, None), ("B", 0, "Revenue", False, None, None, 7e9)],
                                 "accession string, ord int, label string, abstract boolean, dim string, `2024-12-31` double, `2024-09-30` double")
    assert sorted((r.accession, r.ord, r.period, r.val or 0) for r in ST.first_period(wide).collect()) == [
        ("A", 0, "2024-12-31", 9e9), ("A", 1, "2024-12-31", 0), ("B", 0, "2024-09-30", 7e9)]
    assert ST.read_facts(wide).count() == 3
    figures = {r.accession: r.revenue for r in FL.classify_facts(ST.first_period(wide)).collect()}
    assert figures == {"A": 9e9, "B": 7e9}


def test_all_stored_calls_are_counted(spark):
    raw = spark.createDataFrame([("AAA", "Alpha", 2000 + k // 4, k % 4 + 1) for k in range(40)] + [("BBB", "Beta", 2001, 1)], "ticker string, company string, year int, quarter int")
    raw = raw.select("*", F.lit("t").alias("full_text"), F.lit("p").alias("prepared_remarks"), F.lit("q").alias("questions_and_answers"), F.lit("Q").alias("quarter_label"),
                     F.lit("").alias("conference_date"), F.array(F.lit("A")).alias("speakers"), F.lit(1).cast("long").alias("transcript_length"),
                     F.lit(None).cast(S.FIGURES).alias("key_numbers"), F.lit(None).cast("timestamp").alias("fetched_at"))
    shown = {r.ticker: (r.total_transcripts, [t.file for t in r.transcripts]) for r in CA.transcript_index(raw, 3).collect()}
    assert shown == {"AAA": (40, ["Q1_2000.json", "Q2_2000.json", "Q3_2000.json"]), "BBB": (1, ["Q1_2001.json"])}
    assert {r.ticker: len(r.transcripts) for r in CA.transcript_index(raw, None).collect()} == {"AAA": 40, "BBB": 1}
