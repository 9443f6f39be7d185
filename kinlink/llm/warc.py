"""WARC archives: writing records, segmenting long ones, and reading them back.

A record is written as one row of Spark's text sink with the record's closing
blank lines as row separator, so archives reach any file system Spark writes
to under its commit protocol. Blocks over the segment size become a first
record and continuations. The reader parses archives by Content-Length, groups
continuations by their origin, orders them by segment number, verifies the
total length, and decodes chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import load, parts, session_dir

END = "\r\n\r\n"
SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Bytes of records after which an archive is closed; an archive is read whole by one task.
ARCHIVE = 16 << 20
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex40: F.Column) -> F.Column:
    """Bare upper-case base32 of a SHA-1 in hex."""
    groups = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        some = payload[at : at + size]
        out += [b"%x\r\n" % len(some), some, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunk(framed: bytes) -> bytes:
    """Payload of chunked framing; extensions and trailers are skipped. Raises on broken framing."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(number) -> str:
    return f"<urn:page:{'null' if number is None else number}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields if v is not None) + b"\r\n"


def build(page_id, url, payload: bytes, kind: str, refers_to, payload_digest: str, length: int, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without their closing blank lines."""
    address = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    name = record_id(page_id)
    if kind == "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if len(block) <= segment:
        yield _head([*fields, ("Content-Length", len(block))]) + block
        return
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _head([*fields, ("WARC-Segment-Number", 1), ("Content-Length", len(pieces[0]))]) + pieces[0]
    for n, piece in enumerate(pieces[1:], 2):
        last = len(block) if n == len(pieces) else None
        yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{name[1:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last), ("Content-Length", len(piece))]) + piece


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; raises on a broken archive."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        at = begin + int(fields["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        yield fields, archive[begin:at]
        at += 4


def inflate(archive: bytes) -> bytes:
    """An archive's bytes, its gzip members undone; plain archives as they are."""
    out = []
    while archive[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(archive))
        archive = member.unused_data
    return b"".join([*out, archive])


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and decoded body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, unchunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, payload = http_payload(block)
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    own = given if revisit else digest(payload)
    return (_number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(http["content-length"]) if revisit else len(payload), own, fields["warc-type"], _number(fields.get("warc-refers-to")), own == given, (None if revisit else payload) if with_payload else None)


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, payload binary"
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """Record rows of pages: page_id, url, html (responses only), digest, length, kind, refers_to.

    Payload bytes travel once and only for responses: which row is the
    response is settled on digests, pre-aggregated before their shuffle.
    Of repeated (page_id, payload) rows one is the response, the others
    revisit it. Null ids count as larger than all others.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", body.alias("_body")).select("page_id", "url", "_body", F.sha1("_body").alias("_sha"), F.octet_length("_body").cast("long").alias("length"))
    base = base.withColumn("_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # one shuffle then serves both the join and the window
    twin = Window.partitionBy("_sha", "_key").orderBy("url")
    narrow = base.drop("_body").withColumn("_copy", F.row_number().over(twin))
    firsts = base.groupBy("_sha").agg(F.min("page_id").alias("first"))
    known = narrow.join(firsts, "_sha")
    response = (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("_copy") == 1)) | (F.col("length") < least)
    revisits = known.where(~response).select("page_id", "url", F.lit(None).cast("binary").alias("_body"), "_sha", "length", F.lit("revisit").alias("kind"), F.col("first").alias("refers_to"))
    chosen = firsts.select("_sha", F.coalesce(F.col("first").cast("string"), F.lit("")).alias("_key"), "first")
    full = base.join(chosen, ["_sha", "_key"]).withColumn("_copy", F.row_number().over(twin)).where((F.col("_copy") == 1) | (F.col("length") < least))
    wholes = full.select("page_id", "url", "_body", "_sha", "length", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    if least > 0:
        short = base.join(chosen, ["_sha", "_key"], "left_anti").where(F.col("length") < least)
        wholes = wholes.unionAll(short.select("page_id", "url", "_body", "_sha", "length", F.lit("response"), F.lit(None).cast("long")))
    return wholes.unionAll(revisits).withColumn("digest", base32(F.col("_sha")))


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload; other columns are not read; an empty table
    makes empty archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "_body"):
            records = [r for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in build(row[0], row[1], row[2] or b"", row[3], row[4], row[5], row[6], segment)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    rows = typed(pages, least).select("page_id", "url", "_body", "kind", "refers_to", "digest", "length")
    per_file = max(1, ARCHIVE // (segment + 1024))
    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under ``path``, segments reassembled, framing decoded.

    Raises on a missing segment, a wrong total length or broken framing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "content"):
            for content in part.column(0):
                whole, cut = [], []
                for fields, block in parse(inflate(content.as_py())):
                    if "warc-segment-number" in fields:
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        cut.append((origin, int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", -1)), list(fields.items()), block))
                    else:
                        whole.append(_row(fields, block, with_payload))
                yield _batch([(*w, None, None, None, None, None) for w in whole] + [(*(None,) * 8, *c) for c in cut])

    kinds = (*KINDS, pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
    names = [*NAMES, "origin", "number", "total", "fields", "block"]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    parsed = files.mapInArrow(run, f"{SCHEMA}, origin string, number int, total long, fields map<string,string>, block binary")
    pieces = parsed.where("origin IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("pieces"), F.max(F.when(F.col("number") == 1, F.map_entries("fields"))).alias("fields"))

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, found, fields in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if [p["number"] for p in found] != list(range(1, len(found) + 1)):
                    raise ValueError(f"{origin}: segments are missing or repeated")
                block = b"".join(p["block"] for p in found)
                if found[-1]["total"] != len(block):
                    raise ValueError(f"{origin}: {len(block)} bytes, not {found[-1]['total']}")
                rows.append(_row({e["key"]: e["value"] for e in fields}, block, with_payload))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)

    return parsed.where("origin IS NULL").select(*NAMES).unionAll(pieces.select("origin", "pieces", "fields").mapInArrow(join_pieces, SCHEMA))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(load(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


OP1_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), d AS (
  SELECT page_id, url, octet_length(encode(h)) AS payload_bytes,
    translate(
      lpad(to_base(CAST('0x' || substr(s, 1, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(s, 11, 10) AS BIGINT), 32), 8, '0') ||
      lpad(to_base(CAST('0x' || substr(s, 21, 10) AS BIGINT), 32), 8, '0') || lpad(to_base(CAST('0x' || substr(s, 31, 10) AS BIGINT), 32), 8, '0'),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    min(page_id) OVER (PARTITION BY s) AS first_id,
    row_number() OVER (PARTITION BY s, page_id ORDER BY url) AS copy
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id AND copy = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id AND copy = 1 THEN NULL ELSE first_id END AS refers_to,
  url, TRUE AS digest_ok
FROM d
"""
