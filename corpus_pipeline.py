"""From raw documents to packed training sequences, in stages that each write a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from quarterdeck.llm.queries import table, vocabulary
from quarterdeck.llm.shared import shared_folder, written


def _matched(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """docs with or without (left_semi, left_anti) rows of verdicts (doc_id, text_hash). Columns of docs stay."""
    keys = verdicts.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(keys["of_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["of_hash"])
    return docs.join(keys, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject."""
    return _matched(docs, quality_rules.judged(docs).where("not kept").select("doc_id", "text_hash").distinct(), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay where they stand first; a document of which no word is left goes. n_chars follows the text."""
    own = docs.toDF(*(n if n in ("doc_id", "text", "n_chars") else f"own_{n}" for n in docs.columns))  # n_lines and such stay the table's
    made = line_dedup.dedup_lines(own)
    made = made.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return made.select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id (null last), then text hash; of equal rows,
    one. Documents without words are linked with nothing and stay, equal ones too."""
    linked = ngram_join.linked_documents(docs).where("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    linked = written(linked)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = linked.groupBy(F.col("component").alias("of")).agg(F.min(place).alias("first"))
    met = linked.join(first, F.col("component") == F.col("of"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    changed = written(met.where(~is_first | (F.col("rows") > 1)).select("doc_id", "text_hash", is_first.alias("is_first")))
    once = _matched(docs, changed.where("is_first"), "left_semi").dropDuplicates(["doc_id", "text"])
    return _matched(docs, changed, "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a benchmark item stands in."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _matched(docs, found.select("doc_id", "text_hash").distinct(), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The rules' covariance estimates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over all documents; the stages before it are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, shared_folder(spark))
    return docs
