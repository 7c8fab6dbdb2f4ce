"""WARC archives: writing with an index, and reading records by sorted, coalesced byte ranges.

Archives are .warc.gz files, each record a gzip member of its own, so a record can be read alone from its offset and
length. The index has one row a record (file, offset, length, URL, digest, type), written before anything is read back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups

INDEX = (
    "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, "
    "record_type string, refers_to long"
)
#: Ranges of one file closer than this are read as one, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _address(url: str | None) -> str | None:
    """A URL as it may stand in a header line: control characters and spaces percent-encoded."""
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; X-Payload-Length says what it would have had."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_address(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP headers (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(data) -> F.Column:
    """SHA-1 of a binary column in upper-case base 32: five hexadecimal digits make four of base 32."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to of all pages.

    Of pages with equal payloads of min_bytes at least, that with the largest page_id is the response and the others
    revisit it. Null html is an empty payload; a null page_id never is the largest (unless all are null: then all are
    responses); rows that share the largest page_id are all responses. Only payloads that occur twice or more take part
    in a join, on their digests, apart from the few that are very frequent.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("html", "UTF-8")))
    groups = (
        own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("members")).where("members > 1")
    )
    joined = joined_on_groups(own, groups, "payload_digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes a record for each row of with_revisits() to .warc.gz files in folder; the index of all records.

    The index is a lazy table: write it once and read it from there. Each run of a task writes a file of its own name, so
    a repeated or lost task never spoils another's file, and the index has the records of finished tasks only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, size, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip.compress(record_bytes(page_id, url, html.encode(), digest, refers_to, kind == "revisit"), level, mtime=0)
                out.write(data)
                rows.append((name, offset, len(data), page_id, url, digest, size, kind, refers_to))
                offset += len(data)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _schema())
        if out:
            out.close()

    columns = ["page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to"]
    return pages.select(*columns).mapInArrow(write, INDEX)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Reads that cover sorted (offset, length) ranges: (offset, length, positions of the ranges in the list)."""
    reads: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads:
            first, size, members = reads[-1]
            end = max(first + size, offset + length)
            if offset <= first + size + gap and end - first <= most:
                reads[-1] = (first, end - first, [*members, k])
                continue
        reads.append((offset, length, [k]))
    return reads


def read_warc(spark: SparkSession, folder: str, selected: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records of the selected index rows, from the archives: page_id, url, html (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to.

    Index rows are dealt by file and sorted by offset, so that each file is opened by one task and read forwards in
    coalesced ranges. The digest and length of a response are counted from the payload read; a digest that differs from
    the record's header is an error.
    """
    result = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in result.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in result.split(", "))])

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def record(data: bytes) -> dict:
        headers, payload = parse_record(zlib.decompress(data, wbits=31))
        stated, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
        if not revisit and payload_digest(payload) != stated:
            raise ValueError(f"digest of {headers['warc-record-id']} differs")
        return {
            "page_id": page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
            "html": None if revisit else payload.decode(), "payload_bytes": int(headers["x-payload-length"]) if revisit else len(payload),
            "payload_digest": stated, "record_type": headers["warc-type"],
            "refers_to": page(headers["warc-refers-to"]) if revisit else None,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            k = 0
            while k < len(files):
                stop = k
                while stop < len(files) and files[stop] == files[k]:
                    stop += 1
                if files[k] != opened:
                    opened, source = files[k], store.open_input_file(f"{root}/{files[k]}")
                for first, size, members in coalesced(list(zip(offsets[k:stop], lengths[k:stop], strict=True))):
                    data = source.read_at(size, first)
                    rows = []
                    for i in members:
                        at = offsets[k + i] - first
                        rows.append(record(data[at : at + lengths[k + i]]))
                    yield pa.RecordBatch.from_pylist(rows, schema)
                k = stop

    assert names == [f.name for f in schema]
    dealt = selected.select("file", "offset", "length")
    if tasks is None:  # by the archives' number: the index itself is so small that its size says nothing
        tasks = max(dealt.select("file").distinct().count(), 1)
    return dealt.repartition(tasks, "file").sortWithinPartitions("file", "offset").mapInArrow(read, result)
