"""WARC archives with a Zstandard dictionary: written from pages, and read back.

An archive is one file: a leading skippable frame that holds the dictionary, then one Zstandard frame for each record,
compressed with it. The dictionary is built from the archive's own first records. An archive is closed once its records
reach ARCHIVE_BYTES, so it always fits in memory, and any archive can be read alone.

Spark commits the archives as rows (archive, data), so a lost executor's half-written work never shows;
``save_files`` puts each into a .warc.zst file of a folder that all executors can reach.

Which of several equal payloads is the response is settled before by a count over digests, not by a task's order.

Defined results: a null html has an empty payload; payloads of at least ``least`` bytes are compared, and of equal ones
that with the largest page_id is the response (each such row, if the id is repeated), null ids the least; smaller ones
are all responses; a null url has no target; an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, small_batches, shared_dir, table, text_bytes

LEAST_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 0, 8 << 20, 32 << 10, 1 << 20, 3
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha}')}>"


def one_line(url: str) -> str:
    return url.replace("\r", "").replace("\n", "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, head_url: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and refers to the response's record by its id, URI and page."""
    sha = digest(payload)
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, sha)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, head_url, sha)}"]
        head += [f"WARC-Refers-To-Target-URI: {one_line(head_url)}"] if head_url is not None else []
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head.append(f"Content-Length: {len(block)}")
    return CRLF.join(x.encode("utf-8", "replace") for x in head) + CRLF * 2 + block + CRLF * 2


def archive_of(records: list[bytes]) -> bytes:
    """The file of some records. Too few or too small records to build a dictionary from get an empty one."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[:SAMPLE_BYTES])
        size += len(samples[-1])
    try:
        raw = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b""
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compressor.compress, records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw, at = data[8 : 8 + n], 8 + n
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    while at < len(data):
        one = zstandard.ZstdDecompressor(**options).decompressobj()
        whole = one.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        read = at + (1 << 16)
        while not one.eof:
            whole += one.decompress(data[read : read + (1 << 16)])
            read += 1 << 16
        at = min(read, len(data)) - len(one.unused_data)
        head, _, rest = whole.partition(CRLF * 2)
        lines = head.decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[size:] != CRLF * 2:
            raise ValueError("a damaged record")
        yield fields, rest[:size]


def archives(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(archive, data) of all pages."""
    small_batches(pages.sparkSession)
    body = F.coalesce("html", F.lit(""))
    plain = pages.select("page_id", "url", "html").withColumn("sha", F.when(F.octet_length(body) >= least, F.sha1(F.encode(body, "UTF-8"))))
    repeated = plain.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("head"), F.max(F.struct("page_id", "url"))["url"].alias("head_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = plain.join(repeated, "sha", "left").select("page_id", "url", "html", "head", (F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))).alias("revisit"), "head_url")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            data = archive_of(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in batches(it):
            for page_id, url, html, head, revisit, head_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, text_bytes(html), head, revisit, head_url))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return told.mapInArrow(run, "archive string, data binary")


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """The archives as a table. Pages of Parquet hold few rows, since a row is large."""
    archives(pages, least).write.option("compression", "uncompressed").option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1").option("parquet.block.size.row.check.min", "1").option("parquet.block.size.row.check.max", "1").option("parquet.enable.dictionary", "false").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; a response's digest and length are taken from its payload and must be those it states."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data in batch.column(0):
                rows = []
                for fields, block in records_of(data.as_py()):
                    sha, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (digest(block), len(block)) != (sha, n):
                        raise ValueError("a payload isn't what its record states")
                    to = fields.get("X-Refers-To-Page")
                    page = fields.get("X-Page-Id")
                    rows.append((None if page is None else int(page), n, sha, fields["WARC-Type"], None if to is None else int(to)))
                kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")  # rows are whole archives
    return spark.read.schema("archive string, data binary").parquet(path).select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def save_files(stored: DataFrame, folder: str) -> None:
    """Each archive as a file of a folder that every executor can reach; a name is taken only once the file is whole."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row.archive}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.data)
            os.replace(part, os.path.join(folder, f"{row.archive}.warc.zst"))

    stored.foreachPartition(save)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path)
