"""WARC archives: one gzip member per record, read back sequentially.

Writing.  Each task turns its pages into records, compresses every record as a
gzip member of its own and packs members into archives of about
``ARCHIVE_BYTES``.  An archive is one binary row that Spark's text writer
commits as one file, so that archives reach any file system Spark knows and
lost executors leave no half-written file behind.  The text writer ends a row
with a separator; the last byte of a gzip member is the top byte of its length
field, 0 for records under 16 MiB, so that zero byte is what the separator
writes.  An archive whose last record is longer gets a small closing record.

Reading.  A task inflates an archive bit by bit with zlib, takes one record per
member, checks the framing against Content-Length and the payload and block
digests, and goes on at the next member.  Only one record is held at a time.

Null payloads are empty, null ids are written as ``null``.  Pages with equal
payloads of at least ``min_bytes`` bytes: the one with the largest id is the
response, the others revisit it; rows that repeat that largest id are responses
each.  An empty table gives no archives and no records.  Other columns are not
archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.staging import broadcast_if_small, stage, stage_root

ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WARC_DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time

RECORD_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, digest_ok boolean, error string, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", urn or "", re.S)
    return None if not found or found[1] == "null" else found[1]


def warc_record(kind: str, rid: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record, uncompressed: version, fields, blank line, block, two line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": WARC_DATE, **fields}
    head |= {"WARC-Block-Digest": "sha1:" + sha1_base32(block), "Content-Length": str(len(block))}
    # A line break inside a value would start another field.
    lines = [f"{k}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in head.items()]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, response_id, is_response: bool) -> bytes:
    fields = {"WARC-Target-URI": url or f"urn:page:{page_id}", "WARC-Payload-Digest": "sha1:" + sha1_base32(payload)}
    fields["WARC-Payload-Length"] = str(len(payload))
    if is_response:
        fields["Content-Type"] = "application/http;msgtype=response"
        return warc_record("response", record_id(page_id), fields, HTTP_HEAD + payload)
    fields |= {
        "WARC-Refers-To": record_id(response_id),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http;msgtype=response",
    }
    return warc_record("revisit", record_id(page_id), fields, HTTP_HEAD)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info(kind: str) -> bytes:
    return gzip_member(warc_record(kind, f"<urn:uuid:{uuid.uuid4()}>", {"Content-Type": "application/warc-fields"}, b"software: laggard\r\n"))


def pack_archives(batches: Iterator[pd.DataFrame], archive_bytes: int) -> Iterator[pd.DataFrame]:
    """Archives without their last byte, which is always zero."""
    parts, size = [], 0

    def close() -> pd.DataFrame:
        if parts[-1][-1]:
            parts.append(_info("metadata"))
        return pd.DataFrame({"archive": [b"".join(parts)[:-1]]})

    for batch in batches:
        for page_id, url, payload, response_id, is_response in zip(*(batch[c] for c in ("page_id", "url", "payload", "response_id", "is_response"))):
            if not parts:
                parts, size = [_info("warcinfo")], 0
            member = gzip_member(page_record(page_id, url, bytes(payload), response_id, bool(is_response)))
            parts.append(member)
            size += len(member)
            if size >= archive_bytes:
                yield close()
                parts = []
    if parts:
        yield close()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives into the folder ``path``."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("_id"), "url", html.alias("payload"))
    equal = {"_sha": F.sha1("payload"), "_len": F.octet_length("payload"), "_xx": F.xxhash64("payload")}
    rows = rows.withColumns(equal)
    # Only payloads that occur again need a look-up: a narrow table, written once and broadcast if its count is small.
    again = rows.filter(F.col("_len") >= min_bytes).groupBy(*equal).agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = broadcast_if_small(stage(again.filter("_n > 1").drop("_n")))
    rows = rows.join(again, list(equal), "left")
    alone = F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first"))
    rows = rows.select("page_id", "url", "payload", F.col("_first").cast("string").alias("response_id"), alone.alias("is_response"))
    packed = rows.mapInPandas(lambda it: pack_archives(it, archive_bytes), "archive binary")
    out = packed.select(F.col("archive").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(data: memoryview) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of each gzip member, None for the content when it is broken or cut off."""
    at = 0
    while at < len(data):
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not z.eof and pos < len(data):
                out += z.decompress(data[pos : pos + CHUNK])
                pos += CHUNK
        except zlib.error:
            yield at, None
            return
        if not z.eof:
            yield at, None
            return
        yield at, bytes(out)
        at = min(pos, len(data)) - len(z.unused_data)


def parse_record(data: bytes) -> dict:
    """Fields of one record, its payload, and what is wrong with it, if anything."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    kind, length = fields.get("warc-type"), fields.get("content-length", "")
    error = None
    if not lines[0].startswith(b"WARC/") or not length.isdigit():
        error = "no WARC header"
    elif len(body) != int(length) + 4 or body[-4:] != b"\r\n\r\n":
        error = "content length and record differ"
    block = body[: int(length)] if length.isdigit() else body
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http and kind != "revisit" else (b"" if kind == "revisit" else block)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    ok = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", sha1_base32(block))
    if kind != "revisit":
        own = sha1_base32(payload)
        ok, stated = ok and stated in (None, own), own
    n = fields.get("warc-payload-length", "") if kind == "revisit" else str(len(payload))
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_bytes": int(n) if n.isdigit() else None,
        "payload_digest": stated, "digest_ok": ok, "error": error, "payload": payload,
    }


def read_archives(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"))

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, held = [], 0
            for offset, data in members(memoryview(content)):
                row = {"error": "broken gzip member"} if data is None else parse_record(data)
                if not payloads:
                    row.pop("payload", None)
                rows.append(row | {"archive": path, "offset": offset})
                held += len(data or b"") if payloads else 200
                if held >= ARCHIVE_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``, in any order; ``archive`` and ``offset`` tell where each stands.

    A record whose digests do not fit has ``digest_ok`` false; broken framing is
    named in ``error``, and nothing after a broken gzip member can be read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda it: read_archives(it, payloads), RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and return the page records read back, one row per page."""
    spark = pages.sparkSession
    path = path or f"{stage_root(spark)}/laggard/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes)
    records = read_warc(spark, path, payloads=False).filter(F.col("record_type").isin("response", "revisit"))
    urn = lambda c: F.nullif(F.regexp_extract(c, r"(?s)^<urn:page:(.*)>$", 1), F.lit("null"))
    return records.withColumns({"page_id": urn(F.col("record_id")), "refers_to": urn(F.col("refers_to"))})
