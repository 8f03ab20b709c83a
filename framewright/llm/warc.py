"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: response (or revisit), request and metadata; the last two name the first in
WARC-Concurrent-To. Archives are written and read with Spark's own sources, so any store that Spark reaches will do.
Reading follows Content-Length only; what stands inside a block is never searched.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, ship, stored, with_class

#: Records of one archive file at most, and about so many bytes of payload, so that a file fits a task.
RECORDS_A_FILE = 6_000
FILE_BYTES = 64 << 20

RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, http_length long, content_length long, computed_digest string, payload_bytes long, fields map<string,string>"


def base32_sha1(data):
    """Bare upper-case base32 SHA-1 of a binary column: 160 bits as 32 letters, no padding."""
    digest = F.sha1(data)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [letters.substr(F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _id(name, *parts):
    """A record id: a UUID made from a digest of its parts."""
    h = F.sha2(F.concat_ws("|", F.lit(name), *[p.cast("string") for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def revisit_plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page, nth, url, html, payload_bytes, payload_digest, first_page: pages with what their records need.

    page is struct<known, id>: known is false for a null page_id, which so is smaller than all others. first_page is the
    smallest page among pages with an equal payload of at least ``least_bytes``; null where the page itself is the
    response. nth counts rows with equal page and payload from 0: all but the first of them revisit it. Null html counts
    as empty, null url as empty.
    """
    id_ = F.col("page_id").cast("long")
    page = pages.select(F.struct(id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0).cast("long")).alias("id")).alias("page"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    page = page.withColumn("content", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    # ids and digests find the plan; the payloads are shuffled once, to meet it
    ids = page.groupBy("page", "content").agg(F.count("*").alias("times"), F.sum(size).alias("bytes"))
    classes = stored(ids.groupBy("content").agg(F.min("page").alias("least_page"), F.sum("times").alias("size"), F.sum("bytes").alias("bytes")), "payloads")
    total, bytes_ = classes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    found = with_class(ids.select("page", "content"), classes.drop("bytes"), "content", "size", total, F.col("page"))
    # each partition becomes a file: their number follows the bytes
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_ // FILE_BYTES + 1)
    own = page.repartition(n, "page", "content").join(found.repartition(n, "page", "content"), ["page", "content"])
    nth = F.row_number().over(Window.partitionBy("page", "content").orderBy("url")) - 1
    first = (F.col("page") == F.col("least_page")) & (F.col("nth") == 0)
    return own.withColumn("nth", nth).select("page", "nth", "url", "html", size.alias("payload_bytes"), base32_sha1(F.col("html").cast("binary")).alias("payload_digest"), F.when((size >= least_bytes) & ~first, F.col("least_page")).alias("first_page"), F.hex("content").alias("content"))


def write_archives(plan: DataFrame, path: str) -> None:
    """Three records a page as gzip-compressed WARC/1.1 files. Each record ends with two line breaks, the files' line separator."""
    r, n = "\r\n", F.col
    id_ = lambda page: F.when(n(f"{page}.known"), n(f"{page}.id").cast("string")).otherwise(F.lit(""))
    date = F.lit("2024-01-01T00:00:00Z")
    main = _id("main", id_("page"), n("nth"), n("content"))
    uri = F.when(n("url") == "", F.lit("urn:none")).otherwise(F.regexp_replace("url", r"[\r\n]", "%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{r}Content-Type: text/html; charset=utf-8{r}Content-Length: "), n("payload_bytes").cast("string"), F.lit(r + r))
    revisit = n("first_page").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, n("html")))

    def record(kind, key, body, mime, *headers):
        size = F.octet_length(body).cast("string")
        return F.concat(F.lit(f"WARC/1.1{r}WARC-Type: "), kind, F.lit(f"{r}WARC-Record-ID: "), key, F.lit(f"{r}WARC-Date: "), date, F.lit(f"{r}WARC-Target-URI: "), uri, *headers, F.lit(f"{r}Content-Type: {mime}{r}Content-Length: "), size, F.lit(r + r), body)

    digest = F.concat(F.lit(f"{r}WARC-Payload-Digest: sha1:"), n("payload_digest"))
    # what a revisit refers to is the first row of the least page
    refers = F.when(revisit, F.concat(F.lit(f"{r}WARC-Refers-To: "), _id("main", id_("first_page"), F.lit(0), n("content")), F.lit(f"{r}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit(""))
    to = F.concat(F.lit(f"{r}WARC-Concurrent-To: "), main)
    request = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{r}User-Agent: archiver{r}{r}"))
    fields = F.concat(F.lit("page-id: "), id_("page"), F.when(revisit, F.concat(F.lit(f"{r}refers-to-page: "), id_("first_page"))).otherwise(F.lit("")), F.lit(r))
    lines = F.array(
        record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main, block, "application/http; msgtype=response", digest, refers),
        record(F.lit("request"), _id("request", id_("page"), n("nth"), n("content")), request, "application/http; msgtype=request", to),
        record(F.lit("metadata"), _id("metadata", id_("page"), n("nth"), n("content")), fields, "application/warc-fields", to),
    )
    plan.select(F.explode(lines).alias("value")).write.option("lineSep", r + r).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def records_of(data: bytes):
    """(headers, block) of each record of an archive file, unpacked record by record. Header names are lower-cased."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
        headers = {}
        while (line := file.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) < size or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def read_archives(spark, path: str) -> DataFrame:
    """One row a record; payload length and digest are computed from the block of a response."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                out = []
                for h, block in records_of(content):
                    kind = h["warc-type"]
                    length = computed = size = None
                    fields = []
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), None)
                        if kind == "response":
                            size, computed = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "metadata":
                        fields = [(k.strip().decode(), v.strip().decode()) for k, s, v in (x.partition(b":") for x in block.split(b"\r\n")) if s]
                    out.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, length, int(h["content-length"]), computed, size, fields))
                    if len(out) == 5000:
                        yield as_batch(out)
                        out = []
                yield as_batch(out)

    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def as_batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, response, request, metadata: one nested row for each response or revisit record.

    Requests and metadata are joined by the record they name in WARC-Concurrent-To; they are null where there is none,
    and those that name no record found are left out. Of several requests (or metadata) of a capture the one with the
    least record id counts. Record ids identify records, so a capture's key holds at most a handful of rows.
    """
    whole = F.struct("record_id", "target_uri", "warc_date", "content_length", "fields")
    main = records.where("record_type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct("record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "http_length", "computed_digest", "payload_bytes").alias("response"))
    side = lambda kind: F.min_by(F.when(F.col("record_type") == kind, whole), F.when(F.col("record_type") == kind, F.col("record_id")))
    others = records.where("record_type IN ('request', 'metadata') AND concurrent_to IS NOT NULL").groupBy("concurrent_to").agg(side("request").alias("request"), side("metadata").alias("metadata"))
    return main.join(others, F.col("capture_id") == F.col("concurrent_to"), "left").select("capture_id", "response", "request", "metadata")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a capture for every page, read the archives back and assemble them."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(revisit_plan(pages, least_bytes), path)
    # every record is used twice in assembling, but its parsed form is small; the archives are parsed once
    return assemble(stored(read_archives(pages.sparkSession, path), "records"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, from the assembled captures."""
    got = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    page = lambda name: F.nullif(F.col("metadata.fields")[name], F.lit("")).cast("long")
    response = F.col("response.record_type") == "response"
    return got.select(
        page("page-id").alias("page_id"),
        F.when(response, F.col("response.payload_bytes")).otherwise(F.col("response.http_length")).alias("payload_bytes"),
        F.when(response, F.col("response.computed_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page("refers-to-page").alias("refers_to"),
        (~response | (F.col("response.computed_digest").eqNullSafe(F.col("response.payload_digest")) & F.col("response.payload_bytes").eqNullSafe(F.col("response.http_length")))).alias("intact"),
    )


OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_page
    FROM pages
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = least_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least_page THEN NULL ELSE least_page END AS refers_to, true AS intact
FROM p
"""
