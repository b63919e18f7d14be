"""WARC archives whose repeated payloads are revisit records of one response each."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, table, written

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What ends a record; the text sink writes it after each, as its line separator.
RECORD_END = "\r\n\r\n"
#: Payload characters to an archive, about; an archive is read back as one file.
FILE_CHARS = 24_000_000
FIXED_DATE = "1970-01-01T00:00:00Z"


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The digits of Spark's number bases.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_of_hex(c: Column) -> Column:
    """A 160-bit digest of 40 hex digits in base 32, 40 bits at a time: ten digits become eight."""
    quarters = (F.lpad(F.conv(F.substring(c, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.concat(*quarters), _DIGITS, _BASE32)


def _payload(html: str = "html") -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def headers_of(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest of every page; a null html is an empty payload."""
    size = F.octet_length(_payload()).cast("long")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", size.alias("payload_bytes"), base32_of_hex(F.sha1(_payload())).alias("payload_digest"))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers, grouped where all columns are equal, with n (rows), n_response, refers_to and refers_url.

    Only headers are shuffled by digest, and first shrink to the largest (page_id, url) a task. Of the rows
    with a payload of min_bytes or more, that with the largest page_id is the response (of two equal pages
    one, of two urls of one page the larger); all others revisit it. Smaller payloads are all responses.
    """
    keys = ["page_id", "url", "payload_bytes", "payload_digest"]
    same = headers.groupBy(*keys).agg(F.count("*").alias("n"))
    first = headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("first"))
    met = same.join(first, "payload_digest")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    n_response = F.when(F.col("payload_bytes") < min_bytes, F.col("n")).when(own, 1).otherwise(0)
    return met.select(*keys, "n", n_response.cast("long").alias("n_response"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def record_id(page_id: Column, url: Column) -> Column:
    """A version-5-like UUID URN by page and url, equal in every attempt of a task."""
    h = F.sha1(F.concat_ws("\n", _text(page_id), _text(url)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def _uri(url: Column) -> Column:
    """url as one header line: spaces and control characters percent-encoded; a page without one gets an about: URI."""
    safe = F.coalesce(url, F.lit("about:blank"))
    for code in (*range(0x21), 0x7F):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(quote(chr(code))))
    return safe


def _row_key(digest: Column) -> Column:
    """One never-null key of page, url and payload digest; a null differs from every string."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws("\n", told("page_id"), digest, told("url"))


def render(resolved: DataFrame, pages: DataFrame, partitions: int, date: str = FIXED_DATE) -> DataFrame:
    """record: the WARC record of each row of pages as text, without its end.

    Payloads travel once, by page; every row meets its resolved header there and becomes a response or a
    revisit, which has no payload but keeps the HTTP header that tells the payload's full length. date is that of all records, so that a task that is tried again writes the same.
    """
    payloads = pages.select(_row_key(base32_of_hex(F.sha1(_payload()))).alias("k"), F.coalesce("html", F.lit("")).alias("html")).repartition(partitions, "k")
    heads = resolved.withColumn("k", _row_key(F.col("payload_digest")))
    rows = payloads.join(heads, "k").withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    rows = rows.withColumn("kind", F.when(F.col("at") <= F.col("n_response"), "response").otherwise("revisit"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("kind") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-ID: "), _text(F.col("page_id"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("refers_url")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri(F.col("refers_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), _text(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(lines, F.lit("\r\n\r\n"), block)
    return rows.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = FIXED_DATE) -> None:
    """Deduplicated archives of pages at path, gzip-compressed, some 24 million characters to a file.

    Spark's text sink writes them, so a task that is tried again leaves one copy of its archive.
    """
    size = pages.agg(F.sum(F.length("html").cast("long")).alias("c"), F.count("*").alias("n")).first()
    n = max(1, -(-((size["c"] or 0) + 600 * size["n"]) // FILE_CHARS))
    n = max(n, min(pages.sparkSession.sparkContext.defaultParallelism, size["n"] // 1000 + 1))
    records = render(resolve_revisits(written(headers_of(pages), "headers"), min_bytes), pages, n, date)
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def records_in(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, by its Content-Length; a broken archive is an error."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            more = next(data, None)
            if more is None:
                ended = True
            else:
                held.extend(more)
        return len(held) >= n

    while fill(1):
        at = -1
        while (at := held.find(b"\r\n\r\n", max(0, at))) < 0:
            if not fill(len(held) + 1):
                raise ValueError("an archive ends inside a record's header")
        lines = held[:at].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if not fill(at + 8 + n) or held[at + 4 + n : at + 8 + n] != RECORD_END.encode():
            raise ValueError("an archive ends inside a record's block")
        yield headers, bytes(held[at + 4 : at + 4 + n])
        del held[: at + 8 + n]


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of one or several gzip members, a mebibyte of input at a time."""
    view, at, unzip = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        yield unzip.decompress(view[at : at + (1 << 20)])
        at += 1 << 20
        while unzip.eof and unzip.unused_data:
            rest = unzip.unused_data
            unzip = zlib.decompressobj(31)
            yield unzip.decompress(rest)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in records_in(_inflated(content.as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of page {headers['x-page-id']} isn't what its headers say")
                rows.append((number(headers["x-page-id"]), size, digest, kind, number(headers["x-refers-to-page-id"]) if kind == "revisit" else None))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record below path; payloads are checked."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_read, READ)


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_archives of what write_archives makes of all pages, payloads of any size deduplicated."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_archives(spark, path)


OP4_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS sha FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first FROM h),
alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 4), lambda q: list_aggregate(list_transform(range(0, 8), lambda i:
    substr(a, 1 + CAST((CAST(('0x' || substr(sha, CAST(10 * q + 1 AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * i AS INT)) & 31 AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f, alphabet
"""
