"""Token ids of documents as Parquet list columns, in ascending doc_id order, and reading them back.

The files are plain Parquet: `ids` is a list column of 32-bit values under dictionary encoding (or, with
encoding="delta", delta-packed pages), `doc_id`, `n_tokens` and `start_in_part` are delta-packed, row groups and pages
have set sizes, and each page stands in the column and offset index. A reader that wants some documents' ids, or only the
lengths, reads just those pages; Spark prunes columns and uses the page index on filters of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.tokens import ChunkTokenizer, crc32

#: Documents of one file, about.
FILE_ROWS = 6_000


@lru_cache(maxsize=2)
def tokenizer(path: str, spaced: bool) -> ChunkTokenizer:
    """One for each worker process and vocabulary, so that its cache lives on from task to task."""
    return ChunkTokenizer(path, spaced)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = True, passed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_tokens, and the ids of the rows before it in the partition as start_in_part. Null text: empty.

    Row order and partitions stay. passed: further columns to hand on.
    """
    fields = [docs.schema[n] for n in passed]
    schema = "doc_id long, ids array<int>, n_tokens long, start_in_part long"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = tokenizer(vocabulary, spaced), 0
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids, counts = coder.encode(batch.column(1), end_id)
                stop = np.cumsum(counts, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(ids.view(np.int32)))
                columns = [batch.column(0), lists, pa.array(counts.astype(np.int64)), pa.array(done + stop - counts)]
                done += int(stop[-1]) if len(stop) else 0
                yield pa.RecordBatch.from_arrays(
                    columns + [batch.column(2 + i) for i in range(len(names))],
                    ["doc_id", "ids", "n_tokens", "start_in_part", *names],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", *names).mapInArrow(encode, schema)


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    spaced: bool = True,
    passed: tuple[str, ...] = (),
    encoding: str = "dictionary",
    files: int | None = None,
    row_group_bytes: int = 16 << 20,
    page_rows: int = 1000,
) -> None:
    """Writes the ids of all rows to folder, one file a partition, files and rows in ascending doc_id order.

    Null doc_id comes first; rows with one doc_id stand in the order of their texts (equal rows in any order).
    files: number of files, else by the number of rows. A lost executor costs the tasks it had: Spark's commit protocol
    leaves the files of whole tasks only.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    if files is None:
        files = docs.count() // FILE_ROWS + 1
    ordered = docs.repartitionByRange(files, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    coded = encode_documents(ordered, vocabulary, end_id, spaced, passed).withColumn("part", F.spark_partition_id())
    writer = (
        coded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
    )
    writer.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the files and `start`: the ids of all documents before it, over all files.

    The sums over files have one row of 16 bytes a file."""
    rows = spark.read.parquet(folder)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, counted from the lists as read."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat = np.asarray(ids.values).view(np.uint32)
            offsets = np.asarray(ids.offsets)
            crcs = [crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
