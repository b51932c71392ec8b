"""Web archives: writing, reading and revisit resolution.

Records are written through Spark's text sink with the archive's record end (two line breaks) as line separator, so the
files are plain WARC 1.1 below a gzip stream, and the commit protocol covers lost executors. Payloads are bytes; the
sink writes them as they are.

Revisits: only headers (page, URL, digest, length) are shuffled by payload digest; a grouped minimum names the original
of every digest, and rows that repeat it become revisit records whose headers refer to the original. On reading, revisit
records are joined to the response they refer to, which gives their payload's length. Originals of very frequent
digests are attached by broadcast (at most rows / ``HOT`` lines), so one digest may hold any share of all rows.

A null payload is empty; a null URL leaves out its header; a null page id is never an original and is written with no
``Page-Id``. Rows that repeat a page id with an original's payload are responses too. An empty table gives an empty
archive and an empty result."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hot_groups
from lotwise.llm.shared import fresh_path, written

LEAST_BYTES = 100  # smaller payloads are always written out
HOT = 100_000  # rows of one digest (or revisits of one response) beyond which its line is broadcast
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORD = "page_id long, record_type string, url string, payload_digest string, payload binary, refers_to long"


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _clean(url: Column) -> Column:
    """A URL on one line."""
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, original, original_url) of every payload that more than one page holds."""
    first = F.min(F.struct("page_id", "url"))
    big = headers.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    many = big.groupBy("payload_digest").agg(first.alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return many.select("payload_digest", F.col("_f.page_id").alias("original"), F.col("_f.url").alias("original_url"))


def with_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def resolve(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds ``refers_to`` and ``original_url`` to the rows whose payload an earlier page holds."""
    heads = records.select("page_id", "url", "payload_digest", "payload_bytes")
    big = heads.where(F.col("payload_bytes") >= least)
    found = attach(big, originals(heads, least), ["payload_digest"], hot_groups(big, ["payload_digest"], HOT))
    again = found.where(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")))
    again = again.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("original").alias("refers_to"), "original_url").distinct()
    return records.join(again, records.page_id.eqNullSafe(F.col("_p")) & (records.payload_digest == F.col("_d")), "left").drop("_p", "_d")


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """One record per row: a response with its payload, or a revisit with its headers only. The record's length is that
    of its block."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.coalesce(F.col("page_id").cast("string"), F.expr("uuid()")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _clean(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            _header("WARC-Profile", F.lit(PROFILE)),
            _header("WARC-Refers-To", _record_id(F.col("refers_to").cast("string"))),
            _header("WARC-Refers-To-Target-URI", _clean(F.col("original_url"))),
            _header("WARC-Refers-To-Date", F.lit(date)),
            _header("Refers-To-Page-Id", F.col("refers_to").cast("string")),
        )).otherwise(F.lit("")),
        _header("Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, body).alias("value")
    resolved.select(record).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _inflate(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts, rest = [], content
    while rest:  # one member, or one per record
        d = zlib.decompressobj(31)
        parts.append(d.decompress(rest))
        rest = d.unused_data
    return b"".join(parts)


def parse(content: bytes):
    """(headers in lower case, block) of each record of an archive."""
    raw, at = _inflate(content), 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = stop + 4
        at = start + int(head["content-length"])
        yield head, raw[start:at]
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not ended at byte {at}")
        at += 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below a folder. A response's digest is taken anew from its payload; a revisit's is the
    one its header states, and its payload is null."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    kind = head["warc-type"]
                    page = int(head["page-id"]) if "page-id" in head else None
                    if kind == "revisit":
                        row = (page, kind, head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha256:"), None, None, int(head["refers-to-page-id"]))
                    else:
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        row = (page, kind, head.get("warc-target-uri"), hashlib.sha256(body).hexdigest(), len(body), body if payloads else None, None)
                        held += len(body) * payloads
                    rows.append(row)
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, url string, payload_digest string, payload_bytes long, payload binary, refers_to long")


def index(records: DataFrame) -> DataFrame:
    """One line per record, a revisit's payload length being that of the response it refers to."""
    lines = written(records.drop("payload"), "warc-index")
    again = lines.where("record_type = 'revisit'").drop("payload_bytes")
    whole = lines.where("record_type <> 'revisit'")
    lengths = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    keys = ["refers_to", "payload_digest"]
    return whole.unionByName(attach(again, lengths, keys, hot_groups(again, keys, HOT)).select(*whole.columns))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to deduplicated archives in the shared folder, and the index of what was read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(resolve(with_digests(pages)), path)
    return index(read_archives(spark, path, payloads=False))
