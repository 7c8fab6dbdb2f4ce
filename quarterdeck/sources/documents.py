"""Company documents and the registry, from JSON files or from Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck import schemas as S


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """One row per company document, with the file name that the registry knows it by.

    JSON documents are whole-file objects and cannot be split or pruned; write
    them once to Parquet (``sinks.write_company_table``) for repeated queries.
    """
    docs = spark.read.schema(S.COMPANY_DOC).option("multiLine", True).json(path)
    return docs.select(*S.COMPANY_DOC.names, F.col("_metadata.file_name").alias("file")).filter(F.col("ticker").isNotNull())


def read_company_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``sinks.write_company_table``; its ``bucket`` lets a lookup read one folder."""
    return spark.read.parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per registered company; ``pos`` is its place in the registry."""
    whole = spark.read.schema(S.REGISTRY_FILE).option("multiLine", True).json(path)
    return whole.select(F.posexplode("companies").alias("pos", "entry")).select("pos", "entry.*")


def read_raw_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Raw call records written by ``sinks.write_raw_transcripts``."""
    return spark.read.schema(S.RAW_TRANSCRIPT).json(path)


def read_memos(spark: SparkSession, path: str) -> DataFrame:
    """Memos written by ``sinks.write_memos``: (memo, ticker, memo_file)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "memo")
