"""WARC archives: write pages as records, read archives back with segment reassembly.

Writing: each page is a response record whose HTTP block uses chunked transfer framing; blocks over ``SEGMENT`` bytes are cut
into a first record and continuation records.  Spark's text writer puts the records into files, with the CRLF CRLF that ends a
record as its line separator, so files are committed like any other output of a job.

Reading: each file is parsed by its content lengths.  Whole records are decoded at once; segments are grouped by the
identifier of the record they continue, ordered by segment number, checked against the total length that the last one states, joined and
decoded.  Only segments are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, arrow_rows, table

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Largest block of one record, bytes of an HTTP chunk, records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 64 * 1024, 16 * 1024, 1000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

_NAMESPACE = uuid.UUID("8f2f1c1e-6f0f-4f5e-9f5e-2d1f3a7b9c11")
PARSED = "record_type string, record_id string, origin_id string, segment int, total long, page_id long, refers_id string, refers_to long, digest string, payload_bytes long, payload_digest string, data binary"


def record_id(page_id: int | None, digest: str) -> str:
    """Name-based: equal rows get equal ids."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Decode chunked transfer framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(END)
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record or records of one page, without the CRLF CRLF that ends each."""
    rid = record_id(page_id, digest)
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    uri = "".join(c for c in (url or "") if c > " ") or f"urn:page:{page_id}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", b32), ("WARC-Page-ID", page_id)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, profile, ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to), http], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, http], block)
        return
    last = (len(block) - 1) // segment
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, http, ("WARC-Segment-Number", 1)], block[:segment])
    for i in range(1, last + 1):
        own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{rid} {i + 1}')}>"
        total = ("WARC-Segment-Total-Length", len(block) if i == last else None)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", i + 1), total], block[i * segment : (i + 1) * segment])


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write page_id, url, html as gzipped WARC files below ``path``.

    Of equal payloads of at least REVISIT_BYTES the one with the largest page_id is the response, the others are revisits that refer to it; rows that repeat that
    page_id are responses too.  A null html is an empty payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    same = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = Workspace(pages.sparkSession, "digests").save(same, "same")  # stored, so that the join can split a hot payload
    # a payload's own row needs no partner, so only digests that repeat take part in this join
    named = rows.join(same, ["digest", "n"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    kept = named.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for page_id, url, payload, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out += page_records(page_id.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), refers_to.as_py(), segment)
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    done = kept.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(records, "record binary")
    writer = done.select(F.col("record").cast("string").alias("value")).write
    with arrow_rows(pages.sparkSession, 256):
        writer.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def plain(content: bytes) -> bytes:
    """Decompress any number of gzip members; other content stays as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out += [d.decompress(content), d.flush()]
        content = d.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lower-cased) and block of each record."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(fields["content-length"])
        if start + n > len(data):
            raise ValueError("a record is cut off")
        yield fields, data[start : start + n]
        at = start + n


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _row(fields: dict[str, str], block: bytes, keep: bool) -> tuple:
    segment = _number(fields, "warc-segment-number")
    rid = fields["warc-record-id"]
    kind, page = fields["warc-type"], _number(fields, "warc-page-id")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in fields else None
    base = (kind, rid, fields.get("warc-segment-origin-id", rid), segment, _number(fields, "warc-segment-total-length"), page, fields.get("warc-refers-to"), _number(fields, "warc-refers-to-page-id"), digest)
    if segment is not None:
        return (*base, None, None, block)
    if kind != "response":
        return (*base, None, None, None)
    payload = http_payload(block)
    return (*base, len(payload), hashlib.sha1(payload).hexdigest(), payload if keep else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record: record_type, record_id, page_id, refers_to, refers_id, digest, payload_bytes,
    payload_digest and, if asked for, data (the decoded payload; null for revisits).

    Raises if a record is cut off, a segment is missing or the total length differs."""
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for fields, block in parse(plain(content.as_py())):
                    if fields.get("warc-type") in ("response", "revisit", "continuation"):
                        rows.append(_row(fields, block, payloads))
                        held += len(rows[-1][-1] or b"")
                    if len(rows) >= 1000 or held > 1 << 23:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, parts in zip(b.column("origin_id"), b.column("parts")):
                segs = parts.as_py()
                numbers, total = [s["segment"] for s in segs], segs[-1]["total"]
                block = b"".join(s["data"] for s in segs)
                if numbers != list(range(1, len(segs) + 1)) or total != len(block):
                    raise ValueError(f"segments {numbers} of {origin} have {len(block)} bytes of {total}")
                payload = http_payload(block)
                head = segs[0]
                one = ("response", origin.as_py(), origin.as_py(), None, None, head["page_id"], None, None, head["digest"], len(payload), hashlib.sha1(payload).hexdigest(), payload if payloads else None)
                rows += [one] * head["copies"]
            yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = Workspace(spark, "warc").save(files.mapInArrow(records, PARSED), "parsed", rows=1)
    # rows that repeat in the source give equal records: each segment is kept once, with its number of copies
    segments = found.where(F.col("segment").isNotNull()).groupBy("origin_id", "segment").agg(
        F.count("*").cast("int").alias("copies"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.first("data").alias("data"))
    parts = segments.groupBy("origin_id").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "page_id", "digest", "copies", "data"))).alias("parts"))
    every = found.where(F.col("segment").isNull()).unionByName(parts.mapInArrow(whole, PARSED))
    return every.drop("origin_id", "segment", "total")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "archives")
    path = ws.path("warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = ws.save(read_warc(spark, path), "records", rows=64)
    own = back.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    payload = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    payload = ws.save(payload, "payload")
    revisits = back.where("record_type = 'revisit'").select("page_id", "refers_id", "record_type", "refers_to").join(payload, "refers_id", "left")
    return own.unionByName(revisits.drop("refers_id"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id = m THEN NULL ELSE m END AS refers_to
FROM r
"""
