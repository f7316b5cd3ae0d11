"""Op 9: WARC archives with revisit records for payloads that are already stored."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import build, col, shared_dir, written

#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolved(heads: DataFrame, min_bytes: int) -> DataFrame:
    """id, digest, refers_to of the rows whose payload the row with the smallest id holds."""
    first = heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select(F.col("digest").alias("_digest"), "refers_to")
    again = heads.select("id", "digest").distinct().join(first, F.col("digest") == F.col("_digest")).where(~F.col("id").eqNullSafe(F.col("refers_to")))
    return again.select(F.col("id").alias("_id"), "_digest", "refers_to")


def headers(*lines) -> Column:
    return F.concat(*(x for line in lines for x in line), F.lit(CRLF))


def line(name: str, value: Column, *after: str) -> tuple[Column, ...]:
    return F.lit(f"{name}: "), value, *map(F.lit, after), F.lit(CRLF)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes one record per row and returns the folder (default: a new one in the shared folder).

    The payload is the page in UTF-8, null as empty. Of rows with equal payloads of at least ``min_bytes`` bytes that
    with the smallest id is a response (rows that share this id all are), the others revisit it; smaller payloads are all
    responses. Rows with a null id revisit like others, and are responses where no equal payload has an id. Only ids,
    sizes and digests are shuffled to resolve this; payloads move only if the revisits are too many for Spark to
    broadcast. Records go through Spark's text sink, whose commit leaves out failed tasks; files hold about
    ``file_bytes``. Control characters and blanks in URLs are escaped; other columns are ignored; an empty table gives
    an archive without records.
    """
    html = F.coalesce(col(html_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html).alias("digest"))
    heads = written(rows.select("id", "bytes", "digest"), "payload-digests")
    again = written(resolved(heads, min_bytes), "revisits")
    mean = heads.agg(F.avg("bytes")).first()[0] or 0
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    stored = F.col("refers_to").isNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = headers((F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),), line("Content-Length", F.col("bytes").cast("string")))
    block = F.concat(http, F.when(stored, F.col("html")).otherwise(F.lit("")))
    url = F.concat_ws("", F.transform(F.split(F.coalesce("url", F.lit("urn:none")), ""), lambda c: F.when((c <= " ") & (c != ""), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)))
    url = F.when(F.col("url").rlike(r"[\x00-\x20]"), url).otherwise(F.coalesce("url", F.lit("urn:none")))
    head = headers(
        (F.lit(f"WARC/1.1{CRLF}"),), line("WARC-Type", F.when(stored, "response").otherwise("revisit")), line("WARC-Record-ID", name(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), (F.when(stored, "").otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name(F.col("refers_to")), F.lit(CRLF))),),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")))
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", int(max(1, file_bytes / max(1024, mean)))).text(folder)
    return folder


def records(content: memoryview):
    """(header fields, block) of each record; raises where lengths don't fit."""
    at, total = 0, len(content)
    while at < total:
        head, size = b"", 1 << 11
        while b"\r\n\r\n" not in head:
            if at + len(head) == total:
                raise ValueError("an archive ends inside a header")
            head = bytes(content[at:at + size])
            size *= 4
        head = head[:head.index(b"\r\n\r\n")]
        first, *lines = head.decode().split(CRLF)
        if first != "WARC/1.1":
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = at + len(head) + 4
        at = start + int(fields["Content-Length"])
        if bytes(content[at:at + 4]) != b"\r\n\r\n":
            raise ValueError("a record's length doesn't fit")
        yield fields, content[start:at]
        at += 4


def read_archives(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record; digests are recomputed and compared.

    A revisit's length comes from the response it refers to, joined on id and digest.
    """
    schema = pa.schema([("id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in records(memoryview(content.as_buffer())):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = None
                    if fields["WARC-Type"] == "response":
                        head = bytes(block[:256])
                        payload = block[head.index(b"\r\n\r\n") + 4:]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    own, other = (x and x.removeprefix("<urn:page:")[:-1] for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                    rows.append((None if own == "null" else own, size, digest, fields["WARC-Type"], other))
                yield build(schema, *(list(c) for c in zip(*rows))) if rows else pa.RecordBatch.from_pylist([], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    got = written(files.select("content").mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"), "records")
    held = got.where("record_type = 'response'").groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    again = got.where("record_type = 'revisit'").join(held, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    whole = got.where("record_type = 'response'").unionByName(again.withColumn("payload_bytes", F.col("_bytes")).drop("_id", "_digest", "_bytes"))
    return whole.select(F.col("id").cast(id_type).alias("id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
