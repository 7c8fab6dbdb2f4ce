"""Documents, raw calls and memos as files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck import schemas as S
from quarterdeck.functions import text as X
from quarterdeck.sinks.named_files import write_named


def _replace(df: DataFrame, *partitions: str):
    """Rows of a partition go to one place first, or every task would write a file per company."""
    return (
        df.repartition(*partitions).write.partitionBy(*partitions).mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )


def _as_json(df: DataFrame, names: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(n) for n in names if n in df.columns]))


def write_companies(docs: DataFrame, path: str) -> None:
    """One JSON document per company, in the file ``<ticker in lower case>.json``; other companies' files stay."""
    content = _as_json(docs, S.COMPANY_DOC.names)
    write_named(docs.select(X.document_file(F.col("ticker")).alias("file"), content.alias("content")), path)


def write_company_table(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents as Parquet, for queries that read few columns or few companies.

    A file name decides which of ``buckets`` folders a document is in, so a
    lookup of one company (``catalog.company_document``) reads one folder, and
    of its row groups, sorted by file, those that may have it.
    """
    named = docs if "file" in docs.columns else docs.withColumn("file", X.document_file(F.col("ticker")))
    placed = named.withColumn("bucket", company_bucket(F.col("file"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "file")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def company_bucket(file: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON document, entries in the order of ``read_registry``, appended ones last.

    The format is one file, so one task writes it, entry by entry as they come
    sorted; for a registry of many companies or writers see ``sinks.registry``.
    """
    fields = S.REGISTRY_FILE["companies"].dataType.elementType.names
    appended = F.coalesce("appended", F.lit(False)) if "appended" in registry.columns else F.lit(False)
    entries = registry.select(F.lit(1).alias("part"), appended.alias("late"), F.col("pos").cast("long").alias("pos"), _as_json(registry, fields).alias("value"))
    first = entries.agg(F.min(F.struct("late", "pos")).alias("first")).first()["first"] or (False, 0)
    comma = F.when((F.col("late") == first[0]) & (F.col("pos") == first[1]), "").otherwise(",")
    lines = entries.select("part", "late", "pos", F.concat(comma, "value").alias("value"))
    ends = registry.sparkSession.createDataFrame([(0, False, 0, '{"companies": ['), (2, False, 0, "]}")], lines.schema)
    lines.unionByName(ends).repartition(1).sortWithinPartitions("part", "late", "pos").select("value").write.mode("overwrite").text(path)


def write_transcript_index(index: DataFrame, path: str) -> None:
    """The index of each company's calls as ``<ticker in lower case>/_index.json``."""
    content = _as_json(index, ["company", "ticker", "fetched_at", "total_transcripts", "transcripts"])
    write_named(index.select(F.concat(F.lower("ticker"), F.lit("/_index.json")).alias("file"), content.alias("content")), path)


def write_raw_transcripts(raw: DataFrame, path: str) -> None:
    """Raw calls as ``<ticker in lower case>/Q<quarter>_<year>.json``, a file a call, so a large company is spread over tasks."""
    file = F.concat(F.lower("ticker"), F.lit("/"), X.transcript_file(F.col("year"), F.col("quarter")))
    write_named(raw.select(file.alias("file"), _as_json(raw, S.RAW_TRANSCRIPT.names).alias("content")), path)


def write_memos(briefs: DataFrame, path: str) -> None:
    """One markdown text per company under ``ticker=.../memo_file=...``."""
    _replace(briefs.select("ticker", "memo_file", "memo"), "ticker", "memo_file").text(path)
