"""WARC archives: a writer that turns repeated payloads into revisit records, and a reader that salvages damaged files.

The writer packs each record into a gzip member of its own, and members into files of a bounded size, one row of Spark's
text sink each. The reader checks each record (version line, header, length, end mark, payload digest). Where a check
fails it searches for the next gzip member or version line that begins a valid record, goes on there, and logs the bytes
between as quarantined. Records and gaps are rows of one table, so one pass over the archives gives both.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellur.llm.common import durable, read, shared_folder

#: Payloads of fewer bytes are never made revisits.
LEAST = 1_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
GAP = "file string, gap_start bigint, gap_end bigint, reason string"
#: Bytes of a file; its last record may go beyond.
FILE_BYTES = 1 << 25
#: Shared payloads whose digests are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: An empty gzip member, which ends every file (fixed value).
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def plan(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for each row of `pages`.

    Of equal payloads of at least `least` bytes the row with the largest id is the response (all of them, if rows repeat
    it); rows with a null id are always responses. A null page is an empty payload; payloads of any length are taken whole.
    Other columns, whatever their names, take no part. An empty table gives none.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    shared = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n")
    shared = durable(shared)
    copies = (rows.payload_digest == shared.digest) & (rows.page_id < shared.largest) & (rows.payload_bytes >= least)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    if shared.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(shared), copies, "left")
        is_copy = F.col("largest").isNotNull()
        out = both.withColumns({"payload": F.when(is_copy, "").otherwise(F.col("payload")), "record_type": F.when(is_copy, "revisit").otherwise("response"), "refers_to": F.col("largest")})
        return out.select(*names, "record_type", "refers_to")
    # Rows of shared payloads lose the text before they are joined, so a payload isn't sent with its copies.
    revisits = rows.drop("payload").join(shared, copies).select("page_id", "url", F.lit("").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("largest").alias("refers_to"))
    first = rows.join(shared, copies, "left_anti")
    return revisits.unionByName(first.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")}))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes planned records as WARC 1.1 files under `path`, which must not exist: a gzip member for each record.

    A file holds records until it has `file_bytes` bytes, so one that is longer has a file of its own or ends one. Null
    ids and urls are left out of a record's header; control characters of urls become spaces. Other columns take no part.
    An empty table gives files without records.
    """

    def name(page_id, digest):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id"), F.col("payload_digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1f\x7f]", " "))),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to"), F.col("payload_digest")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(pack_member(x.as_py()))
                n += len(held[-1])
                if n >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    whole = records.withColumn("block", block).select(F.encode(F.concat(head, F.col("block"), F.lit(END)), "UTF-8").alias("value"))
    # Each row is a file's bytes, which the sink writes as they are; the separator behind it is an empty member.
    files = whole.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def pack_member(record: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(wbits=31)
    return c.compress(record) + c.flush()


class Bad(ValueError):
    pass


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The valid record that begins at a position, and where it ends."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 12]):
        raise Bad("no version line")
    if (cut := data.find(b"\r\n\r\n", at)) < 0:
        raise Bad("no end of header")
    if re.search(rb"WARC/1\.[01]\r\n", data[at + 10 : cut]):
        raise Bad("a version line within the header")
    fields = {}
    for line in data[at:cut].split(b"\r\n")[1:]:
        key, sep, value = line.partition(b":")
        if not sep:
            raise Bad("no field name")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Bad("no length")
    start = cut + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("no end mark after the length")
    block = data[start:end]
    kind, body = fields.get("warc-type"), block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and hashlib.sha1(body).hexdigest() != digest:
        raise Bad("digest differs")
    page = re.match(r"<urn:page:(-?\d+):", fields.get("warc-record-id", ""))
    to = re.match(r"<urn:page:(-?\d+):", fields.get("warc-refers-to", ""))
    length = fields.get("x-payload-length", "")
    return {
        "page_id": int(page[1]) if page else None,
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": int(to[1]) if to else None,
        "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else len(body),
        "payload_digest": digest if kind == "revisit" else hashlib.sha1(body).hexdigest(),
        "payload": body,
    }, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be unpacked of the gzip member at a position, where it ends, and what is wrong with it, if anything."""
    d, out = zlib.decompressobj(31), []
    for i in range(at, len(data), 1 << 16):
        try:
            out.append(d.decompress(data[i : i + (1 << 16)]))
        except zlib.error as e:
            return b"".join(out), at, f"gzip: {e}"
        if d.eof:
            return b"".join(out), min(len(data), i + (1 << 16)) - len(d.unused_data), ""
    return b"".join(out), at, "gzip: cut off"


class Ahead:
    """The next place of a pattern at or behind a position; positions may only rise, so each byte is searched once."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.at = data, pattern, -1

    def __call__(self, least: int) -> int:
        if self.at < least:
            self.at = self.data.find(self.pattern, least)
            if self.at < 0:
                self.at = len(self.data)
        return self.at


def salvage(data: bytes, packed: bool = True) -> Iterator[tuple[dict | None, tuple[int, int, str] | None]]:
    """(record, None) for every valid record of an archive's bytes, and (None, gap) for the bytes that are none.

    A gzip member (none, unless `packed`) holds one record or many, or nothing; a gap inside one is given as the member's
    place. Of a damaged member the records before the damage are kept, and the search goes on behind its first bytes.
    """
    at = gap = 0
    reason = ""
    members, lines = Ahead(data, b"\x1f\x8b\x08"), Ahead(data, b"WARC/1.")
    while at < len(data):
        found, end, bad = [], at, ""
        if packed and data.startswith(b"\x1f\x8b", at):
            plain, end, bad = _member(data, at)
            for record, hole in salvage(plain, False):
                if record:
                    found.append(record)
                else:
                    bad = bad or hole[2]
        else:
            try:
                record, end = _record(data, at)
                found = [record]
            except Bad as e:
                bad = str(e)
        if (found or not bad) and at > gap:
            yield None, (gap, at, reason)
            gap, reason = at, ""
        for r in found:
            yield r, None
        if not bad:
            at = gap = end
            continue
        reason = reason or bad
        if found and end > at:  # a whole member with bad bytes inside
            yield None, (at, end, bad)
            at = gap = end
            reason = ""
            continue
        at = min(members(at + 1) if packed else len(data), lines(at + 1))
    if gap < len(data):
        yield None, (gap, len(data), reason)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, ..., payload, file, gap_start, gap_end, reason): a row for each salvaged record and for each quarantined run of bytes.

    Rows of gaps have the first failed check as `reason`, those of records have none. A task holds one file at a time and
    a few megabytes of records; empty files give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = [x.split() for x in f"{RECORD}, {GAP}".split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows, size = b.column(0)[i].as_py(), [], 0
                for record, gap in salvage(b.column(1)[i].as_py() or b""):
                    rows.append(record | {"file": file} if record else dict(zip(("file", "gap_start", "gap_end", "reason"), (file, *gap), strict=True)))
                    size += len(record["payload"]) if record else 0
                    if size > 1 << 23 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(work, f"{RECORD}, {GAP}")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all `pages`, as read back from the archives written of them.

    These archives are whole, so a quarantined byte in them is an error.
    """
    write(plan(read(spark, sf_dir, "pages")), path := f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    lost = F.raise_error(F.concat(F.lit("bytes lost in "), "file", F.lit(": "), "reason"))
    found = read_archives(spark, path).withColumn("record_type", F.when(F.col("reason").isNull(), F.col("record_type")).otherwise(lost.cast("string")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS largest FROM s WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
       CASE WHEN s.page_id < m.largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN s.page_id < m.largest THEN m.largest END AS refers_to
FROM s LEFT JOIN m ON s.payload_digest = m.payload_digest AND s.payload_bytes >= 1000
"""
