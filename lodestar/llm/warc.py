"""WARC archives: written with an index of byte ranges, read back by coalesced range reads of selected records."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, scratch, written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _uri(url: str | None) -> str:
    """The URL on one header line."""
    return "".join(c for c in url or "" if c.isprintable())


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int) -> tuple[bytes, str]:
    """One gzip member with one WARC record, and its payload's digest."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush(), digest


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member that ``record`` wrote."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes a record for each row of ``pages`` to gzip WARC files below ``folder`` (any URI that pyarrow.fs opens), and their index.

    Of records with equal payloads of at least ``revisit_from`` bytes, those with the largest page_id are responses
    and the others revisit them; with repeated page_ids every row that has the largest is a response. Null html: an empty payload.
    Null page_ids revisit, if another page_id has the payload. A file's name has its task attempt's number, so files of failed or doubled
    attempts stay apart, and the index, which is committed with the task, never names them. Returns the index (INDEX_SCHEMA): offset and length
    of each record's gzip member, URL and digest. Empty table: no records. Other columns are ignored.

    Which payloads are equal is counted on digests alone; html is shuffled once, and hot payloads are dealt apart.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    same = rows.filter(F.octet_length("html") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    rows = join_by_key(rows, written(same, "payloads"), "sha", "n", F.xxhash64("page_id", "url"), rows.count())

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            index: list[tuple] = []
            parts = []
            if out is None:
                store, path = fs.FileSystem.from_uri(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = refers_to is not None and refers_to != page_id
                member, digest = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit, date, level)
                index.append((page_id, url, uri, at, len(member), digest, "revisit" if revisit else "response"))
                at += len(member)
                parts.append(member)
            out.write(b"".join(parts))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*index, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.close()

    index = rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(selected: DataFrame, gap: int = 1 << 16, span: int = 1 << 23, task_bytes: int = 1 << 25) -> DataFrame:
    """Reads the records that rows of an index name: page_id, url, record_type, payload (binary; null for revisits), payload_bytes, payload_digest, refers_to.

    Rows are dealt by ranges of (file, offset) to tasks of about ``task_bytes`` and sorted; neighbours that lie within
    ``gap`` bytes are read at once, up to ``span`` bytes. Every payload's digest is checked against its header and the
    index; a mismatch raises. Repeated rows are read once each; an empty selection gives an empty table.
    """
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0)), F.countDistinct("file")).first()
    tasks = max(1, math.ceil(total[0] / task_bytes), min(total[1], selected.sparkSession.sparkContext.defaultParallelism))
    dealt = selected.select("file", "offset", "length", "payload_digest").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def emit(uri: str, run: list[tuple[int, int, str]]) -> pa.RecordBatch:
        store, path = fs.FileSystem.from_uri(uri)
        begin, end = run[0][0], max(o + n for o, n, _ in run)
        with store.open_input_file(path) as f:
            f.seek(begin)
            data = f.read(end - begin)
        out = []
        for offset, length, digest in run:
            headers, payload = parse(data[offset - begin : offset - begin + length])
            revisit = headers["WARC-Type"] == "revisit"
            said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if said != digest or not revisit and payload_digest(payload) != said:
                raise ValueError(f"{uri} at {offset}: the payload's digest isn't {digest}")
            out.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], None if revisit else payload, int(headers["X-Payload-Length"]), said, number(headers.get("WARC-Refers-To"))))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, run = "", []
        for batch in batches:
            for file, offset, length, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (file != uri or offset - (run[-1][0] + run[-1][1]) > gap or offset + length - run[0][0] > span):
                    yield emit(uri, run)
                    run = []
                uri = file
                run.append((offset, length, digest))
        if run:
            yield emit(uri, run)

    return dealt.mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all ``pages`` to a new folder in the shared one and reads every record back."""
    return read_records(write_archives(pages, scratch(pages.sparkSession, "warc")))
