"""WARC archives: one monolithic gzip stream per file, normalised to one member per record.

``write_monolithic`` renders records as text in Spark and lets Spark's writer make the files: each
is a single gzip stream, which nothing can be read from the middle of.  ``normalise`` inflates
each file's stream once, from its start, writes every record as a gzip member of its own, and
beside each archive a sidecar index of record offsets, which is also returned as a table.
``read_back`` seeks to the offsets and parses each member alone.

Cases: null html: an empty payload; null url: empty; rows that repeat a page_id and a payload are
written once each and share their record type; an empty table writes no record; extra columns
are ignored.  Payloads under ``SHORT`` bytes are never revisits.  Files are written under another
name and renamed, so a task that runs again leaves whole files.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, saved, shared_dir, shuffle_partitions

SHORT, RECORDS_PER_FILE, LEVEL = 1000, 2048, 6
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STRETCH = 1 << 20
INDEX = "archive string, offset long, length long, page_id long, record_type string"


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", short: int = SHORT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Only digests are grouped; the table of repeated ones is written first, so that Spark knows
    its size when it chooses how to join.
    """
    df = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    df = df.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})
    long = F.col("payload_bytes") >= short
    first = df.where(long).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "warc-repeated").withColumnsRenamed({"payload_digest": "d", "payload_bytes": "b"})
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = df.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_text() -> F.Column:
    """A record's bytes but for the blank lines that end it, as one string column."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    response = F.col("record_type") == "response"
    block = F.concat(F.lit(HTTP), F.when(response, F.col("html")).otherwise(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(text("url"), "[\\r\\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("WARC-Payload-Length: "), text("payload_bytes")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_monolithic(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Files of whole gzip streams; ``per_file`` bounds what one normalising task inflates."""
    out = records.select(record_text().alias("value")).write
    out.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record of an inflated stream."""
    buffer, at = b"", 0
    chunks = iter(chunks)

    def need(n: int) -> bool:
        nonlocal buffer, at
        while len(buffer) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            buffer, at = buffer[at:] + more, 0
        return True

    while need(1):
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not need(len(buffer) - at + 1):
                raise ValueError("a record's header doesn't end")
        head = buffer[at:end]
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = len(head) + 4 + int(headers["Content-Length"]) + 4
        if not need(size):
            raise ValueError("a record's block is cut short")
        whole = buffer[at : at + size]
        at += size
        yield headers, whole[len(head) + 4 : -4], whole


def inflated(chunks: Iterator[bytes], step: int = STRETCH) -> Iterator[bytes]:
    """A gzip stream's bytes in turn, at most ``step`` at a time; further members, if any, follow on."""
    z = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(chunk, step)
            chunk = z.unused_data or z.unconsumed_tail
    yield z.flush()


def member(record: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def normalise(spark, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite the monolithic files of ``source`` below ``target`` in the same store; returns the offset index.

    Files are streamed, so a task's memory holds a stretch and a record, whatever a file's size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gz").load(source).select("path")  # contents are streamed

    def run(batches):
        store, folder = fs.FileSystem.from_uri(target)
        origin = fs.FileSystem.from_uri(source)[1]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = os.path.basename(path).removesuffix(".txt.gz") + ".warc.gz"
                rows, offset, part = [], 0, f"{folder}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out, store.open_input_file(f"{origin}/{os.path.basename(path)}") as whole_file:
                    for headers, _, whole in split_records(inflated(iter(lambda f=whole_file: f.read(STRETCH), b""))):
                        packed = member(whole, level)
                        out.write(packed)
                        page = headers["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
                        rows.append((f"{target}/{name}", offset, len(packed), int(page) if page else None, headers["WARC-Type"]))
                        offset += len(packed)
                with store.open_output_stream(f"{part}.idx") as out:
                    out.write("".join(f"{o}\t{n}\t{'' if p is None else p}\t{t}\n" for _, o, n, p, t in rows).encode())
                store.move(part, f"{folder}/{name}")
                store.move(f"{part}.idx", f"{folder}/{name}.idx")
                for k in range(0, len(rows), 1024):
                    columns = zip(*rows[k : k + 1024])
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    store, folder = fs.FileSystem.from_uri(target)
    store.create_dir(folder, recursive=True)
    return saved(files.mapInArrow(run, INDEX), "warc-index")


def read_back(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of each record.

    Each record is read by its offset alone.  A response's size and digest are measured on the
    payload that was read; a revisit, which has none, carries those of its full payload.
    """

    def run(batches):
        opened, name = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    if opened is not None:
                        opened.close()
                    store, path = fs.FileSystem.from_uri(archive)
                    opened, name = store.open_input_file(path), archive
                opened.seek(offset)
                headers, block, _ = next(split_records(iter([zlib.decompress(opened.read(length), 31)])))
                page = headers["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
                page_id = int(page) if page else None
                if headers["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload))
                else:
                    first = headers["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">")
                    rows.append((page_id, int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(first), None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened is not None:
            opened.close()

    # Dealt by stretches of an archive, so that a task reads a bounded number of bytes in turn.
    dealt = index.repartition(shuffle_partitions(index.sparkSession), "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, per_file: int = RECORDS_PER_FILE, level: int = LEVEL, **columns: str) -> tuple[DataFrame, str]:
    """Write, normalise and index; the index table and the archives' folder."""
    spark = pages.sparkSession
    base = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    if "://" not in base and ":/" not in base:
        base = f"file://{base}"
    write_monolithic(typed(pages, **columns), f"{base}/whole", per_file)
    return normalise(spark, f"{base}/whole", f"{base}/members", level), f"{base}/members"
