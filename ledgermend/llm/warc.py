"""WARC archives: a writer of whole records and a reader that salvages damaged files.

Writing is plain Spark: the record is a string expression and the text sink's
line separator is the empty line pair that ends a WARC record, so part files are
archives as they stand.  Of records with equal payloads one is a response and
the others revisit it; the payload's SHA-256 is grouped first (with map-side
combining) and joined back on narrow rows.

Method of reading: where a record fails its checks (version line, headers,
length, closing empty lines, digest, gzip checksum) the reader searches for the
next member or version line that reads well, goes on from there, and logs the
bytes between as a quarantined gap.  One archive file is read by one task, so files are kept
small (``RECORDS_PER_FILE``, ``FILE_BYTES``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.workspace import fresh_path, stored

#: A file is read whole: so many records at most, and fewer if the largest page would make more than FILE_BYTES of them.
RECORDS_PER_FILE = 1000
FILE_BYTES = 256 << 20
#: Bytes of a gzip member that are unpacked at a time.
PIECE = 1 << 16
MIN_REVISIT_BYTES = 100
#: Rows of a digest and a number, about 120 bytes each.
MAX_BROADCAST_ROWS = 250_000
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError says which check failed."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("version")
    cut = data.find(b"\r\n\r\n", at, at + (1 << 20))
    if cut < 0:
        raise ValueError("headers")
    headers = {}
    for line in data[at:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("headers")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("length")
    start = cut + 4
    stop = start + int(headers["content-length"])
    if stop > len(data):
        raise ValueError("truncated")
    block = data[start:stop]
    tail = data[stop : stop + 4]
    if tail != b"\r\n\r\n" and stop + len(tail) != len(data):
        raise ValueError("ending")
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", payload_of(headers, block))):
        if what is not None and not digest_agrees(headers.get(name, ""), what):
            raise ValueError("digest")
    return headers, block, stop + len(tail)


def digest_agrees(label: str, data: bytes) -> bool:
    """Whether ``algorithm:digest`` in base 32 or hexadecimal, told apart by length, is that of ``data``; other labels can't be checked."""
    kind, _, said = label.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    own, said = hashlib.new(kind, data).digest(), said.strip().rstrip("=")
    if len(said) == 2 * len(own):
        return said.lower() == own.hex()
    spelled = base64.b32encode(own).decode().rstrip("=")
    return said.upper() == spelled if len(said) == len(spelled) else True


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The body of a response's HTTP message; None for records without a payload, and for bodies in transfer coding (their digest may be of the decoded one)."""
    if headers.get("warc-type") != "response":
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    return None if b"\ntransfer-encoding:" in head.lower() else body


def read_member(data: bytes, at: int) -> tuple[list, int]:
    """Records of the gzip member at ``at`` and the member's end."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(data[end : end + PIECE]))
            end = min(end + PIECE, len(data))
    except zlib.error:
        raise ValueError("member") from None
    if not unpack.eof:
        raise ValueError("truncated")
    plain = b"".join(parts)
    records, inside = [], 0
    while inside < len(plain):
        headers, block, inside = read_record(plain, inside)
        records.append((headers, block))
    return records, end - len(unpack.unused_data)


def salvage(data: bytes):
    """``("record", start, end, headers, block)`` and ``("gap", start, end, reason, None)``, in file order, covering all bytes."""
    at, size = 0, len(data)
    while at < size:
        gap, why, probe = at, "", at
        while True:
            try:
                if data.startswith(MEMBER, probe):
                    records, end = read_member(data, probe)
                else:
                    headers, block, end = read_record(data, probe)
                    records = [(headers, block)]
                break
            except ValueError as failed:
                why = why or str(failed)
            member = data.find(MEMBER, probe + 1)
            line = re.compile(rb"(?<=\n)" + re.escape(VERSION)).search(data, probe + 1)
            found = [x for x in (member, line.start() if line else -1) if x >= 0]
            if not found:
                yield "gap", gap, size, why, None
                return
            probe = min(found)
        if probe > gap:
            yield "gap", gap, probe, why, None
        for headers, block in records:
            yield "record", probe, end, headers, block
        at = end


SCHEMA = "archive string, kind string, start_byte long, end_byte long, reason string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _read(batches):
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            name, data, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"", []
            for kind, start, end, about, block in salvage(data):
                if kind == "gap":
                    rows.append((name, kind, start, end, about, None, None, None, None, None))
                    continue
                payload = payload_of(about, block)
                if payload is None:
                    length, digest = int(about.get("x-payload-length", 0)), about.get("warc-payload-digest", "").partition(":")[2]
                else:
                    length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                rows.append((name, kind, start, end, None, _page(about.get("warc-record-id")), about.get("warc-type"), length, digest, _page(about.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, plain or gzip members.

    A gap row has kind ``gap``, its byte range and the first check that failed;
    an empty file gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, SCHEMA)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One record per row of ``pages(page_id, url, html)``, in archives under ``path``.

    Null html is an empty payload, and a null url an empty target.  Among equal
    payloads of at least ``min_bytes`` rows with the smallest page_id are
    responses (a null page_id counts as largest); repeated rows write a record each.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(html).cast("long")
    narrow = pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), size.alias("size"))
    first = narrow.where((F.col("size") >= min_bytes)).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), size.alias("size"))
    # The repeated digests are written and counted: few are broadcast, which spares shuffling the html; more are shuffled.
    first = stored(first.select("digest", "first_id"), "warc-copies")
    if first.count() <= MAX_BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    end = F.lit("\r\n")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), end)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), end,
        F.lit("WARC-Record-ID: "), urn(F.col("page_id")), end,
        F.lit("WARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        digest, F.lit("X-Payload-Length: "), F.col("size").cast("string"), end,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")), end)).otherwise(""),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    record_rows = rows.select(record.alias("value"))
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 1
    per_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES // largest))
    record_rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, OCTET_LENGTH(ENCODE(html)) AS n, SHA256(html) AS digest FROM p),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY digest) AS first_id, COUNT(*) OVER (PARTITION BY digest) AS copies FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND copies > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND copies > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f"""

QUERIES = {"op7_warc": op7}
ORACLES = {"op7_warc": ORACLE}
