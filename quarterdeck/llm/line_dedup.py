"""Removal of repeated passages by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups

WINDOW_LINES = 3
#: A line counts if it has a character other than these.
BLANK = " \\t-\\r"


def line_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """A row for each window: window_hash, doc_id, text_hash, first, last (positions of its lines, from 0).

    Windows run over the lines with a word; blank lines between them belong to them but do not tell them apart.
    """
    numbered = F.transform(F.split("text", "\n"), lambda line, k: F.struct(k.alias("at"), line.alias("line")))
    with_word = F.filter(numbered, lambda x: x["line"].rlike(f"[^{BLANK}]"))
    hashed = F.transform(with_word, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.hash(x["line"]).alias("b")))

    def window(k):
        own = [F.get("hashed", k + i) for i in range(lines)]
        return F.struct(
            F.struct(F.xxhash64(*(x["a"] for x in own)).alias("a"), F.hash(*(x["b"] for x in own)).alias("b")).alias("window_hash"),
            own[0]["at"].alias("first"), own[-1]["at"].alias("last"),
        )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), hashed.alias("hashed"))
    windows = F.when(F.size("hashed") >= lines, F.transform(F.sequence(F.lit(0), F.size("hashed") - lines), window))
    # the outer form, as the filter that Spark adds to the inner one would cut the texts a second time
    each = found.select("doc_id", "text_hash", F.explode_outer(windows).alias("w")).where("w is not null")
    return each.select("w.window_hash", "doc_id", "text_hash", "w.first", "w.last")


def covered_positions(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """doc_id, text_hash and the line positions that later occurrences of repeated windows cover, merged, as `covered`."""
    windows = line_windows(docs, lines)
    place = F.struct("doc_id", "text_hash", "first")
    groups = windows.groupBy("window_hash").agg(F.min(place).alias("earliest"), F.count("*").alias("members")).where("members > 1")
    later = joined_on_groups(windows, groups, "window_hash").where(place > F.col("earliest"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    each = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))
    return spans.select("doc_id", "text_hash", F.array_distinct(each).alias("covered"))


def dedup_lines(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """All rows and columns of docs with repeated passages taken out of `text`, and n_lines, n_removed (long).

    The first occurrence of a window, by doc_id and then position, stays; the lines of each later one go, in other
    documents or in the same. A line's text always stays where it stands first. Null text stays null with 0 lines; a
    text of fewer lines than a window stays as it is; rows that share doc_id and text count as one occurrence each
    at the same place and come out alike; null doc_id is the smallest. Columns of docs called n_lines or n_removed are replaced.
    """
    covered = covered_positions(docs, lines).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "covered")
    names = docs.drop("n_lines", "n_removed").columns
    own = docs.select(*names).toDF(*(f"own_{k}" for k in range(len(names))))  # further columns may have any name
    at = {name: f"own_{k}" for k, name in enumerate(names)}
    met = own.join(covered, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("of_id")) & (F.xxhash64(at["text"]) == F.col("of_hash")), "left")
    met = met.withColumn("lines", F.split(at["text"], "\n"))
    met = met.withColumn("stays", F.when(F.col("covered").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")))
    text = F.when(F.col("covered").isNull(), F.col(at["text"])).otherwise(F.array_join(F.transform("stays", lambda k: F.get("lines", k)), "\n"))
    total = F.when(F.col(at["text"]).isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long")
    columns = [(text if name == "text" else F.col(at[name])).alias(name) for name in names]
    return met.select(*columns, total.alias("n_lines"), removed.alias("n_removed"))
