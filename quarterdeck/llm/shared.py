"""Folders, written tables and joins that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's full address under spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of its
    own on this machine; on a cluster, where other machines could not read that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarterdeck-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", f"{full}/quarterdeck-{uuid.uuid4().hex}")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cannot lose it."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def key_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns alone, so that further columns of the table can clash with nothing."""
    return df.select(*(df[n] for n in names))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text. Fully equal rows have equal keys and get equal results."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"))


def joined_on_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", hot_share: int = 1000) -> DataFrame:
    """rows joined with groups (one row a key, with its number of rows in `rows` as column `members`).

    A key with more than one in hot_share of all members is hot. There are fewer than hot_share such keys whatever the
    data, so their groups are broadcast and their rows stay where they are; all other keys are small and are shuffled.
    The column members goes.
    """
    limit = (groups.agg(F.sum("members").alias("total")).first()["total"] or 0) // hot_share + 1
    hot = groups.where(F.col("members") > limit).drop("members")
    cold = groups.where(F.col("members") <= limit).drop("members")
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("hot_key"))), F.col(key) == F.col("hot_key"), "left")
    of_hot = marked.where("hot_key is not null").drop("hot_key").join(F.broadcast(hot), key)
    of_cold = marked.where("hot_key is null").drop("hot_key").join(cold, key, how)
    return of_hot.unionByName(of_cold)
