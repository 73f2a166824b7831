"""Web archives: records written from pages, and transactions assembled from the records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut_lineage, shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 0  # shorter payloads are never revisits
RECORDS_PER_FILE = 4_000  # a reader holds one compressed archive of so many records
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, fields string, sound boolean")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StringType())
def payload_digest(html: pd.Series) -> pd.Series:
    return pd.Series([base32_sha1((h or "").encode("utf-8", "surrogatepass")) for h in html])


def _id(kind, *parts):
    """A record id: a UUID made of the hash of what the record stands for."""
    h = F.sha1(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)),
                    F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def _record(kind: str, record_id, uri, content_type: str, body, *headers):
    """Text of one record up to the blank lines that end it."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"),
             F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content_type}"),
             F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of *pages*.

    Of the rows with equal payloads of *least_bytes* bytes or more the one with the smallest page_id
    (null last; a repeated row once) is a response, all others are revisits that name it. The three
    records of a row stand side by side and point to the response or revisit with WARC-Concurrent-To.
    Spark's text writer closes each record with two line ends and compresses the archives.
    """
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")).alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": payload_digest("html"), "_at": F.monotonically_increasing_id()})
    rows = cut_lineage(rows)
    large = rows.select("digest", "page_id", "_at", F.octet_length("html").alias("n")).filter(F.col("n") >= least_bytes)
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_at")).alias("o"), F.count("*").alias("k"))
    again = first.filter("k > 1").select("digest", F.col("o.page_id").alias("o_page"), F.col("o._at").alias("o_at"))
    ids = (rows.select("digest", "page_id", "_at", F.octet_length("html").alias("n")).join(again, "digest")
           .filter((F.col("n") >= least_bytes) & (F.col("_at") != F.col("o_at"))).select("_at", "o_page", "o_at"))
    linked = rows.join(ids, "_at", "left")
    own, target = _id("capture", F.col("page_id"), F.col("_at")), _id("capture", F.col("o_page"), F.col("o_at"))
    revisit = F.col("o_at").isNotNull()
    uri, payload = F.col("uri"), F.col("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(payload))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    together = F.concat(F.lit("WARC-Concurrent-To: "), own)
    answer = F.when(revisit, _record("revisit", own, uri, "application/http; msgtype=response", http, digest, F.lit(f"WARC-Profile: {PROFILE}"),
                                     F.concat(F.lit("WARC-Refers-To: "), target))).otherwise(
        _record("response", own, uri, "application/http; msgtype=response", http, digest))
    asked = F.concat(F.lit("GET "), F.when(uri == "", "/").otherwise(uri), F.lit(" HTTP/1.1\r\n\r\n"))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = F.array(_record("request", _id("request", F.col("page_id"), F.col("_at")), uri, "application/http; msgtype=request", asked, together),
                      answer, _record("metadata", _id("metadata", F.col("page_id"), F.col("_at")), uri, "application/warc-fields", fields, together))
    (linked.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Records of one archive, plain or gzip in one or many members, by their stated lengths."""
    for name, head, body in _records(_inflate(content)):
        kind = head.get("warc-type", "")
        payload = body.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else body
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        sound = kind != "response" or digest is None or base32_sha1(payload) == digest
        yield (name, kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest,
               len(payload), body.decode("utf-8", "replace") if kind == "metadata" else None, sound)


def _inflate(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _records(data: bytes) -> Iterator[tuple[str | None, dict[str, str], bytes]]:
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(head.get("content-length", "0") or 0)
        yield head.get("warc-record-id"), head, data[start:start + size]
        at = data.find(b"WARC/", start + size)


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives under *path*; a task holds one archive at a time."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        for frame in batches:
            for content in frame["content"]:
                yield pd.DataFrame(list(parse_archive(bytes(content))), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its request, response or revisit, and metadata.

    A record belongs to the capture that it names as concurrent, or to its own id. Of several records
    of one kind the one with the least id stands; a kind that is missing is null. All parts of a row
    meet in one aggregation, which merges before it shuffles.
    """
    part = F.struct("record_id", "type", "refers_to", "uri", "digest", "payload_bytes", "fields", "sound")

    def one(*kinds):
        return F.min(F.when(F.col("type").isin(*kinds), part))

    capture = F.coalesce("concurrent_to", "record_id")
    return records.filter("record_id IS NOT NULL").groupBy(capture.alias("capture_id")).agg(
        one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def captures(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write *pages* to archives, read them back and assemble the transactions.

    A null html is an empty payload, a null url an empty target. Equal rows are captures of their own.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_archives(pages, path, least_bytes)
    return assemble(read_archives(spark, path))


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read from the archives.

    The length of a revisit's payload is that of the response it refers to.
    """
    rows = cut_lineage(captures(pages).select("capture_id", "response",
                                              F.nullif(F.regexp_extract("metadata.fields", r"page_id: (\d*-?\d*)", 1), F.lit("")).cast("long").alias("page_id")))
    named = rows.filter("response.type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("target_page"),
                                                             F.col("response.payload_bytes").alias("target_bytes"))
    back = rows.filter("response.type = 'revisit'").select("capture_id", F.col("response.refers_to").alias("target"), "page_id", "response")
    seen = back.join(named, "target", "left").select(
        "page_id", F.col("target_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("target_page").alias("refers_to"))
    fresh = rows.filter("response.type = 'response'").select(
        "page_id", F.col("response.payload_bytes"), F.col("response.digest").alias("payload_digest"), F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"))
    return fresh.union(seen)
