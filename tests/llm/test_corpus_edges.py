"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarterdeck.llm import decontamination, html_text, line_dedup, lm_scoring, ngram_join, packing, quality_rules, resampling, token_files, warc
from quarterdeck.llm.queries import vocabulary
from quarterdeck.llm.shared import joined_on_groups, shared_folder, written
from tests.llm import brute

CLASHES = (
    "words", "hashes", "text_hash", "n", "n_words", "n_lines", "covered", "_lines", "of_id", "of_hash", "window", "minimum", "item_id", "set_key",
    "token", "members", "row_key", "h", "c", "shape", "held_out", "key", "kept", "distance", "peers", "good_id", "host", "template", "part", "value",
)
LONG = " ".join(f"word{k % 5000}\n" if k % 9 == 0 else f"word{k % 5000}" for k in range(120_000))
SHARED = "A shared line here\nand another of them\nwith a third one\n"
DOCS = [
    (None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t\r", None, "a"), (4, "three words only", "en", "a"),
    (5, "Three WORDS only", "en", "a"), (6, SHARED + "first of its own", "en", "hot"), (6, SHARED + "first of its own", "en", "hot"),
    (7, SHARED + "second of its own", "en", "hot"), (8, LONG, "en", "hot"), (9, LONG + " end", "en", "hot"), (None, "a text without an id has ten words in it at least", "en", "a"),
    (10, "퟿é  x y 日本語 \U0001f600", "zz", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
PAGES = "page_id long, url string, html string"


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(DOCS, SCHEMA)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


def labels(spark, rows=((4, 1, 0), (6, 1, None), (8, 0, 1), (None, 1, 0), (99, 1, 0))):
    return with_clashes(spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int"))


def items(spark, rows=((1, "three words only"), (2, None), (3, ""), (None, "a text without an id has ten words"), (4, "three words only"))):
    return with_clashes(spark.createDataFrame(list(rows), "item_id long, text string"))


def ids_of(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))


ALL_IDS = [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]


def test_quality(spark, docs, empty):
    rows = quality_rules.judged(docs).collect()
    assert ids_of(rows) == ALL_IDS
    texts = {i: t for i, t, *_ in DOCS if i is not None}
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(texts[r.doc_id])
        assert r.kept is not None and not (r.kept and r.base_failed)
    assert quality_rules.judged(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert ids_of(rows) == ALL_IDS
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[6].text == SHARED + "first of its own" and of[7].text == "second of its own" and of[9].text.count("\n") < 3
    assert of[1].text is None and of[1].n_lines == 0 and of[2].text == "" and of[4].n_removed == 0 and of[6].words == "clash"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_ngram_join(docs, empty):
    rows = ngram_join.linked_documents(docs).collect()
    assert ids_of(rows) == ALL_IDS
    expected = brute.components({i: t for i, t, *_ in DOCS if i is not None})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == expected
    assert expected[5] == (1, 4) and expected[9][1] == 8 and expected[1] == (0, 1)
    assert ngram_join.linked_documents(empty).count() == 0


def test_decontamination(spark, docs, empty):
    found = decontamination.contaminated(docs, items(spark)).collect()
    assert sorted(((r.doc_id or 0, r.item_id or 0) for r in found)) == [(0, 0), (4, 1), (4, 4), (5, 1), (5, 4)]
    assert decontamination.contaminated(empty, items(spark)).count() == 0
    assert decontamination.contaminated(docs, items(spark).limit(0)).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1).toPandas()
    totals = rows.groupby("doc_id", dropna=False).length.sum()
    assert totals[1] == totals[2] == totals[3] == 1 and totals[6] % 2 == 0 and rows.doc_id.isna().any()
    assert (rows.groupby("sequence_id").length.sum() <= 2048).all()
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_token_files(spark, docs, empty):
    for table, ids in ((docs, ALL_IDS), (empty, [])):
        folder = shared_folder(spark)
        token_files.write_token_files(table, folder, vocabulary("byte_bpe_50k.json"), 2)
        rows = token_files.token_digests(token_files.read_token_files(spark, folder)).collect()
        assert ids_of(rows) == ids
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
        assert [r.doc_id for r in rows] == ids  # ascending, nulls first
        for r in rows:
            if r.doc_id in (1, 2):
                assert (r.n_tokens, r.ids_crc32) == (1, zlib.crc32((2).to_bytes(4, "little")))


def test_resampling(spark, docs, empty):
    rows = resampling.resampled(docs, labels(spark), share=1.0).collect()
    assert ids_of(rows) == ALL_IDS
    assert all(r.n_features == 0 and r.log_weight == 0 for r in rows if r.doc_id in (1, 2, 3))
    none = resampling.resampled(docs, labels(spark).limit(0), share=0.5)
    assert none.count() in (6, 7) and none.agg(F.max(F.abs("log_weight"))).first()[0] == 0
    assert resampling.resampled(empty, labels(spark)).count() == 0


def test_lm_scoring(docs, empty):
    rows = lm_scoring.scored(docs).collect()
    assert ids_of(rows) == ALL_IDS
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3)) and all(r.score < 0 and r.base_score < 0 for r in rows)
    same = [r for r in rows if r.doc_id == 6]
    assert same[0] == same[1]
    assert lm_scoring.scored(empty).count() == 0


def test_pages(spark):
    rows = [(None, None, None), (1, "http://h/1", None), (2, "no url", "<p>x"), (3, "http://h/3", "<" * 50_000), (4, "http://h/4", "<div>" * 20_000 + "t"), (4, "http://h/4", "<div>" * 20_000 + "t")]
    for table, n in ((with_clashes(spark.createDataFrame(rows, PAGES)), 6), (with_clashes(spark.createDataFrame([], PAGES)), 0)):
        texts = html_text.extract(table).collect()
        assert len(texts) == n and all(r.n_chars == len(r.text) for r in texts)
        folder = shared_folder(spark)
        index = written(warc.write_warc(warc.with_revisits(table), f"{folder}/a"))
        back = warc.read_warc(spark, f"{folder}/a", index).collect()
        assert sorted((r.page_id or 0) for r in back) == sorted((r[0] or 0) for r in rows)[: n]
        assert all((r.record_type == "revisit") == (r.html is None) for r in back)


def test_hot_groups(spark):
    """A key with a third of all rows stays where it is; the result is that of a join."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("members"))
    got = joined_on_groups(rows, groups, "k").select("k", "id", "low").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(groups, "k").select("k", "id", "low").collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, docs, empty, name):
    """Each stage on its own takes such tables; all but the last keep the columns."""
    items(spark).select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    for table in (docs, empty, docs.select("doc_id", "text", "lang", "source")):
        made = stage(spark, table, str(tmp_path))
        if name != "packing":
            assert made.schema.names == table.columns and [f.dataType for f in made.schema] == [f.dataType for f in table.schema]
        assert (made.count() == 0) == (table is empty)
