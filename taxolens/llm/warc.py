"""WARC output and input: transactions of request, response or revisit, metadata.

Each page becomes three records. The request has an id of its own; response (or
revisit) and metadata name it in ``WARC-Concurrent-To``. Reading parses the archives
record by record and assembles a capture by joining its records through that name;
a revisit's payload is found through ``WARC-Refers-To``. One nested row per capture.

Of pages with equal payloads (by SHA-1 and length) of at least ``REVISIT_BYTES``, the
largest page_id is the response, others revisit it. The largest id of a payload comes
from a pre-aggregated group-by, so a payload of a third of all pages is no hot task.

Defined cases: a null or empty html is an empty payload; a null url has no target header;
rows equal to the response's page_id and payload are responses too and share its record
id; a null page_id with a payload that others share is a revisit, or a response where all
are null; payloads of exactly ``REVISIT_BYTES`` may be revisited; a very long payload is one
record, held in memory while it is written and read; columns beside page_id, url and html
stay out, whatever their names; an empty table makes no archive and no capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import fresh_path, keep, open_shared, publish, release, small_batches, utf8

REVISIT_BYTES = 1000
#: An archive is closed when its records have so many bytes.
FILE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
RECORD = "file string, record_id string, kind string, concurrent_to string, refers_to string, url string, digest string, page_id long, payload_bytes long, payload_digest string"


def plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest, bytes, first`` (page_id of the response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    shared = keep(
        rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "payloads",
    )
    return rows.join(shared, ["digest", "bytes"], "left").select("page_id", "url", "html", "digest", "bytes", "first")


def _id(*parts) -> str:
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def transaction(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """The three records of a page; ``key`` names the row."""
    target = None if url is None else re.sub(r"[\r\n\s]", lambda m: f"%{ord(m.group()) & 255:02X}", url)
    revisit = first is not None and first != page_id
    request = _id("request", key)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", target), ("WARC-Concurrent-To", request)]
    if revisit:
        answer = _record("revisit", _id("revisit", key), [*shared, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id("response", first, digest)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http)
    else:
        own = _id("response", page_id, digest) if first is not None else _id("response", key)
        answer = _record("response", own, [*shared, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http + payload)
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    return b"".join(
        gzip.compress(x, 6, mtime=0)
        for x in (
            _record("request", request, [("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
            answer,
            _record("metadata", _id("metadata", key), [*shared, ("Content-Type", "application/warc-fields")], fields),
        )
    )


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of gzip members, one a record; returns their paths."""
    small_batches(pages.sparkSession)

    def write(batches):
        part, number, row, out = TaskContext.get().partitionId(), 0, 0, io.BytesIO()

        def flush():
            path = f"{folder}/part-{part:06d}-{number:06d}.warc.gz"
            publish(path, out.getvalue())
            return pa.RecordBatch.from_pydict({"path": [path]}, pa.schema([("path", pa.string())]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 5)]
            for page_id, url, digest, first, payload in zip(*columns, utf8(batch.column(2))):
                out.write(transaction(f"{part}|{row}|{page_id}", page_id, url, payload, digest, first))
                row += 1
                if out.tell() >= file_bytes:
                    yield flush()
                    number, out = number + 1, io.BytesIO()
        if out.tell():
            yield flush()
        release()

    # the rows of a task and their order must be the same if it runs again
    rows = plan(pages).sortWithinPartitions("page_id", "digest", "url")
    return keep(rows.mapInArrow(write, "path string"), "archives")


def records(stream) -> iter:
    """(headers, block) of each record of an archive, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        yield headers, block


def read_records(archives: DataFrame) -> DataFrame:
    """The records of archives (a ``path`` column), payloads digested."""
    n = max(1, min(10_000, archives.count()))
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.string()]

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_shared(path, "rb") as f, gzip.open(f) as stream:
                    for h, block in records(io.BufferedReader(stream, 1 << 16)):
                        kind = h["warc-type"]
                        page = size = digest = None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        elif kind == "metadata" and (m := re.search(rb"page-id: (-?\d+)", block)):
                            page = int(m.group(1))
                        rows.append((path, h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, page, size, digest))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        release()

    return archives.select("path").repartition(n, F.xxhash64("path")).mapInArrow(read, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: page_id, request, answer and metadata as structs, and the
    response a revisit refers to."""
    part = lambda *kinds: found.where(F.col("kind").isin(*kinds))
    request = part("request").select(F.col("record_id").alias("key"), F.struct("record_id", "file", "url").alias("request"))
    answer = part("response", "revisit").select(F.col("concurrent_to").alias("key"), F.struct("record_id", "file", "kind", "url", "digest", "refers_to", "payload_bytes", "payload_digest").alias("answer"))
    meta = part("metadata").select(F.col("concurrent_to").alias("key"), F.struct("record_id", "file").alias("metadata"), "page_id")
    captures = keep(request.join(answer, "key").join(meta, "key"), "captures")
    whole = (
        captures.where("answer.kind = 'response'")
        .groupBy(F.col("answer.record_id").alias("response_id"))
        .agg(F.max("page_id").alias("response_page"), F.max("answer.payload_bytes").alias("response_bytes"), F.max("answer.payload_digest").alias("response_digest"))
    )
    asked = captures.where("answer.kind = 'revisit'").select("key", F.col("answer.refers_to").alias("response_id"))
    # one row per response that is asked for; the join spreads a hot one (AQE)
    referred = asked.join(whole, "response_id", "left").select("key", F.struct("response_id", "response_page", "response_bytes", "response_digest").alias("original"))
    return captures.join(referred, "key", "left").select("page_id", "request", "answer", "metadata", "original")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and assemble the captures."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return assemble(keep(read_records(write_archives(pages, folder)), "records"))
