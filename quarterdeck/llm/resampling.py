"""Importance resampling: the documents most like labelled good ones, by hashed n-gram models and Gumbel top-k.

Words and pairs of words are hashed to a fixed number of buckets. Two generative models, of the target (labelled good
texts) and of all raw text, give each document the logarithm of the ratio of its probabilities under them. With Gumbel
noise added, the k largest are a sample without replacement in proportion to the ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.shared import written
from quarterdeck.llm.words import Run, mix, runs

#: Buckets of words, and of pairs after them: pairs are many and rare, so they take fewer.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 16, 1 << 13
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
#: Labelled rows that the target model is fitted on, at most: those whose ids hash lowest.
TARGET_ROWS = 20_000
SMOOTHING = 0.5
_PAIR = np.uint64(0x9FB21C651E98DF25)


def features(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of words of a run, and the row of each."""
    words, row = run.words(), run.row
    both = row[1:] == row[:-1]
    pairs = mix(words[:-1][both] * _PAIR + words[1:][both])
    values = np.concatenate([mix(words) % np.uint64(WORD_BUCKETS), pairs % np.uint64(PAIR_BUCKETS) + np.uint64(WORD_BUCKETS)])
    return values.astype(np.int64), np.concatenate([row, row[1:][both]])


def gumbel(*key: Column) -> Column:
    """Gumbel noise that depends on the key columns only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) of each bucket; the counts are over all documents' whole texts."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    chosen = good.orderBy(F.xxhash64("good_id"), "good_id").limit(TARGET_ROWS)
    marked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
            for run in runs(batch.column(0)):
                bucket, row = features(run)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[run.first + row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n_features, log_weight of every row; null or wordless text weighs 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for run in runs(batch.column(2)):
                rows = len(run.offsets) - 1
                bucket, row = features(run)
                sums[run.first : run.first + rows] = np.bincount(row, ratios[bucket], rows)
                counts[run.first : run.first + rows] = np.bincount(row, minlength=rows)
            columns = [batch.column(0), batch.column(1), pa.array(counts), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_features", "log_weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(score, "doc_id long, text_hash long, n_features long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column without nulls, by counts in ever finer bins; k from 1 to the number of rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # so many rows as bins at most
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The sampled rows: doc_id, text_hash, n_features, log_weight, key (log_weight plus noise).

    share of all rows is sampled, rounded; None: the share of target rows among the labelled. Rows that tie at the last place
    (equal rows: the noise is drawn from id and text) all come in. Labels of rows that are not there do no harm; without
    any target label the weights are 0 and the sample is uniform. An empty table has an empty sample.
    """
    docs = docs.select("doc_id", "text")
    if share is None:
        good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).cast("int")
        share = labels.agg(F.avg(good)).first()[0]
        share = 1.0 if share is None else share
    keyed = weights(docs, log_ratios(docs, labels)).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), F.col("text_hash")))
    keyed = written(keyed)
    k = round(share * keyed.count())
    return keyed.where(F.col("key") >= kth_largest(keyed, "key", k)) if k else keyed.limit(0)
