"""Helpers of several operators."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_list(ord_by: Column, value: Column, where: Column | None = None) -> Column:
    """Aggregate: values as a list by an order key (the value may hold maps).

    Callers limit the rows of a group first (latest n, first k), so that a list
    stays small whatever the group size was.
    """
    row = F.struct(ord_by.alias("o"), value.alias("v"))
    rows = F.collect_list(row if where is None else F.when(where, row))
    by_key = F.array_sort(rows, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return F.transform(by_key, lambda r: r["v"])


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows that are computed once: a Parquet table when a path is given, else a checkpoint.

    Used after calls to a model, which must not run again when a later stage
    retries. The checkpoint folder is the shared one that the session names in
    ``spark.checkpoint.dir``; without any the checkpoint is an error.
    """
    if path:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's address under ``spark.checkpoint.dir``, the one that all executors share.

    Where that is unset a local session gets one on its own machine; on a
    cluster, where other machines could not read it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='quarterdeck-')).rstrip('/')}/quarterdeck-{uuid.uuid4().hex}"


def exists(spark: SparkSession, pattern: str) -> bool:
    """True when there is a file or folder at an address or of a pattern, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
