"""The pipeline's stages, each held against plain versions of its operator on what the stage before it kept."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quarterdeck.llm import quality_rules
from quarterdeck.llm.shared import written
from tests.llm import brute
from tests.llm.test_corpus_operators import check_pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The table that goes into each stage, and the last result."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, FOLDER))
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_stage(tables):
    kept = {r.doc_id for r in quality_rules.judged(tables[0]).where("kept").collect()}
    assert set(texts(tables[1])) == kept and kept < set(texts(tables[0]))


def test_clean_documents_stay(tables):
    """Of documents labelled good, the rules reject those alone that fail the fixed base conditions (too short, repetitive)."""
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    before = texts(tables[0])
    good = set(labels.doc_id[(labels.quality == 1) & (labels.toxic.fillna(0) == 0)]) & set(before)
    for i in good - set(texts(tables[1])):
        n, *_, repeats = brute.counts(before[i])
        assert n < 10 or 100 * repeats > 20 * n


def test_line_stage(tables):
    before, after = texts(tables[1]), texts(tables[2])
    expected = brute.without_repeats(before)
    assert after == {i: t for i, (t, gone) in expected.items() if not gone or brute.WORD.search(t)}


def test_duplicate_stage(tables):
    before, after = texts(tables[2]), texts(tables[3])
    assert set(after) == {i for i, (_, c) in brute.components(before).items() if i == c}


def test_duplicate_stage_keeps_one_of_each_group(spark):
    """Null and repeated ids: groups go by id and text, so clean rows stay whatever ids they share with copies."""
    words = [f"w{k}" for k in range(60)]
    a, near, other, alone = " ".join(words), " ".join([*words[:59], "x"]), " ".join(words[::-1]), "quite another text of seven words altogether"
    given = [
        (None, a), (1, near), (None, "a clean text without an id at all"), (None, ""), (None, ""), (2, near), (2, alone), (3, None),
        (None, other), (None, other), (4, alone + " and more that makes it differ a lot from it"),
    ]
    docs = spark.createDataFrame([(*g, "clash") for g in given], "doc_id long, text string, component string").repartition(3)
    rows = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    kept = [(1, near), (None, given[2][1]), (None, ""), (None, ""), (2, alone), (3, None), (None, other), given[10]]
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(kept, key=str) and all(r.component == "clash" for r in rows)


def test_decontamination_stage(tables):
    before, after = texts(tables[3]), texts(tables[4])
    bench = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    found = brute.contained(before, dict(zip(bench.item_id, bench.text, strict=True)))
    assert set(before) - set(after) == {i for i, _ in found}


def test_packing_stage(tables):
    own = texts(tables[4])
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = coder.encode_batch([t or "" for t in own.values()], add_special_tokens=False)
    check_pieces(tables[5].toPandas(), {i: np.array(e.ids + [1], "<u4") for i, e in zip(own, coded, strict=True)})


def test_columns(tables):
    for table in tables[1:5]:
        assert table.columns == tables[0].columns


def test_registered(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in entry.queries()}
    got = entry.queries()["pipeline"](spark, FOLDER).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32"]
    totals = lambda df: df.groupby("doc_id").length.sum().to_dict()
    assert totals(got) == totals(tables[5].toPandas()) and set(columns) <= set(got.columns)
