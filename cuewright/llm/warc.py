"""Operator 7, WARC archives with segmented records, and their reassembly.

Writing: every page becomes a WARC/1.1 response record whose block is an HTTP response in chunked transfer
coding, or, if an earlier page has the same payload, a revisit record. A block longer than `segment` characters is
split into a first record and continuation records (WARC-Segment-Number, -Origin-ID, and the total length on
the last one). Archives are plain .warc text written by Spark: the writer's line separator is the two empty
lines that end a record, and a file holds about FILE_BYTES.

Reading: archives are parsed record by record by their Content-Length. Whole records are decoded where they
are parsed; segments are grouped by their origin's identifier, ordered by number, checked (numbers from 1
without gaps, one closing segment, the stated total length) and joined. The chunked framing is then decoded,
and the payload's digest is compared with the one in the header: any mismatch fails the job.

Defined cases: null html counts as an empty payload; a null url is written as urn:page:<id>; payloads under
100 bytes are never revisits; of equal payloads the smallest page_id is the response; rows that repeat the
page_id of a response are responses as well; a null page_id is never a revisit's target unless alone and sorts
last; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, shared_dir, small_or_join, stage

LEAST_REVISIT, SEGMENT, CHUNK, FILE_BYTES = 100, 32_768, 4_096, 16 << 20
_END = "\r\n\r\n"


def chunked(payload: str, size: int = CHUNK) -> str:
    """Chunked transfer coding; chunks end between characters."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.append(f"{len(part.encode('utf-8', 'surrogatepass')):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """Decode chunked transfer coding; raises ValueError on broken framing."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            if data[at : at + 2] != b"\r\n":
                raise ValueError("no end after the last chunk")
            return b"".join(out)
        out.append(data[at : at + size])
        if len(out[-1]) != size or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def record(fields: list[tuple[str, object]], block: str) -> str:
    """One record without the empty lines that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block.encode("utf-8", "surrogatepass")))])
    return f"WARC/1.1\r\n{head}\r\n{block}"


def records_of(page_id, url, html: str, refers_to, target, segment: int, row: str) -> list[str]:
    """The records of one page; row tells apart rows that repeat a page_id."""
    raw = html.encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(raw).hexdigest()
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} row {row}')}>"
    uri = "".join(url.split()) if url else f"urn:page:{page_id}"
    common = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(raw))]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record([("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", "".join(target.split()) if target else f"urn:page:{refers_to}"), ("X-Refers-To-Page", refers_to), *common], "")]
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), *common], block)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} row {row} segment {number}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        if number == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block.encode("utf-8", "surrogatepass"))))
        out.append(record(fields, part))
    return out


def parse(data: bytes):
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        start, size = end + 4, int(fields["Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield fields, data[start : start + size]
        at = start + size + 4


def payload_of(block: bytes, fields: dict) -> bytes:
    """Payload of a whole HTTP response block, checked against the record's digest."""
    head, body = block.split(b"\r\n\r\n", 1)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
    return payload


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PARSED = _FOUND + ", origin string, number int, total long, fields map<string,string>, block binary"


def write_archives(pages: DataFrame, segment: int = SEGMENT, file_bytes: int = FILE_BYTES) -> str:
    """Write all pages as WARC archives in the shared folder; returns their folder."""
    spark = pages.sparkSession
    arrow_limits(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = rows.select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= LEAST_REVISIT)
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    again = stage(sized.groupBy("digest").agg(F.min(first)["page_id"].alias("original"), F.min(first)["url"].alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-repeated")
    told = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(small_or_join(again), "digest", "left")
    told = told.select("page_id", "url", "html", F.when((F.col("original") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("original").isNotNull()), F.col("original")).alias("refers_to"), "target")

    def make(batches):
        """An archive's records as one row: as many as come to file_bytes, so that none is longer than that and one record."""
        part, seq, held, size = TaskContext.get().partitionId(), itertools.count(), [], 0
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in records_of(*page, segment, f"{part}.{next(seq)}"):
                    held.append(made)
                    size += len(made.encode("utf-8", "surrogatepass")) + len(_END)
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.string())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.string())], names=["value"])

    folder = f"{shared_dir(spark)}/stage/warc-{uuid.uuid4().hex}"
    told.mapInArrow(make, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", 1).text(folder)
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives."""

    def parse_files(batches):
        for batch in batches:
            for content in batch.column(0):
                out: list[dict] = []
                for fields, block in parse(content.as_py()):
                    row = {"page_id": int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None, "payload_bytes": int(fields["X-Payload-Length"]) if "X-Payload-Length" in fields else None,
                           "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"), "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None}
                    if "WARC-Segment-Number" in fields:
                        total = fields.get("WARC-Segment-Total-Length")
                        row |= {"origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "number": int(fields["WARC-Segment-Number"]), "total": int(total) if total else None, "fields": list(fields.items()) if row["record_type"] == "response" else None, "block": block}
                    elif row["record_type"] == "response":
                        row["payload_bytes"] = len(payload_of(block, fields))
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]))

    def join_segments(batches):
        for batch in batches:
            out = []
            for fields, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields = dict(fields)
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                    raise ValueError(f"segments of {fields['WARC-Record-ID']} are not complete")
                out.append({"page_id": int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None, "payload_bytes": len(payload_of(block, fields)), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": "response", "refers_to": None})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    # an archive holds FILE_BYTES and a record at most, and no record is longer than a segment and its header
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    records = stage(files.mapInArrow(parse_files, _PARSED), "warc-records", "lz4")
    whole = records.filter("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # a page's segments carry its origin's identifier: a group is one record, its size bounded by one page
    groups = records.filter("origin is not null").groupBy("origin").agg(F.first("fields", ignorenulls=True).alias("fields"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))
    return whole.unionByName(groups.select("fields", "total", "parts").mapInArrow(join_segments, _FOUND))


def op7_warc_segments(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


#: DuckDB twin of op7_warc_segments.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
                  CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""
