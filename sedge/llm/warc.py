"""WARC archives: native writing, framing-exact reading and assembly of transactions.

Every page gives three records: a request, a response (or a revisit of an equal,
earlier-chosen response) and metadata. Request and metadata name the response in
``WARC-Concurrent-To``; reading groups records by that identifier and emits one
nested row per capture.

Defined cases: a null html is an empty payload; a null url is written as an empty
target; equal page ids and wholly repeated rows each give their own capture; an
empty table gives no captures; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scratch, table

#: Payloads below this many bytes are never deduplicated.
MIN_REVISIT_BYTES = 1000
#: Copies of the list of repeated payloads, against hot payloads in the join.
SALTS = 64
#: Captures per archive file; a file is read as a whole by one task.
CAPTURES_PER_FILE = 1000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "warc_date string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _head(kind: Column, rid: Column, extra: list[Column], length: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"), *extra, F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def records(pages: DataFrame) -> DataFrame:
    """One string ``value`` per page: its three records, each but the last followed by two line ends."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row")
    )
    base = base.withColumn("rid", _uuid("response", F.col("page_id"), F.col("row")))
    again = (
        base.where(F.col("n") >= MIN_REVISIT_BYTES)
        .groupBy("digest", "n")
        .agg(F.max(F.struct("page_id", "rid")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    df = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int")).join(again, ["digest", "n", "salt"], "left")
    revisit = F.coalesce(F.col("first.page_id") != F.col("page_id"), F.lit(False)) | (F.col("first.page_id").isNotNull() & F.col("page_id").isNull())
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    host = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1)
    path = F.regexp_replace(uri, "^[a-zA-Z]+://[^/?#]*", "")
    get = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    about = F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)))
    target, to, gap = _line("WARC-Target-URI", uri), _line("WARC-Concurrent-To", F.col("rid")), F.lit(CRLF + CRLF)
    request = F.concat(_head(F.lit("request"), _uuid("request", F.col("page_id"), F.col("row")), [target, to, F.lit("Content-Type: application/http; msgtype=request")], F.octet_length(get)), get)
    shown = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    more = F.when(revisit, F.concat(F.lit(CRLF), _line("WARC-Refers-To", F.col("first.rid")), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit(""))
    response = _head(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.col("rid"),
        [target, F.lit("Content-Type: application/http; msgtype=response"), F.concat(_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), more)],
        F.octet_length(http) + F.octet_length(shown),
    )
    metadata = F.concat(_head(F.lit("metadata"), _uuid("metadata", F.col("page_id"), F.col("row")), [target, to, F.lit("Content-Type: application/warc-fields")], F.octet_length(about)), about)
    parts = [request, gap, response, http, shown, gap, metadata]
    return df.select(F.concat(*[p.cast("binary") for p in parts]).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write gzipped archives; the text writer's line end is the gap that closes a record."""
    records(pages).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def opened(content: bytes) -> BinaryIO:
    """An archive's records as a stream, whether it is plain, one gzip member or one member per record."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def parse(archive: BinaryIO) -> Iterator[dict]:
    """Records of one archive, by their declared lengths, whatever the payloads hold; one record is held at a time."""
    count = 0
    while first := archive.readline():
        count += 1
        if not first.startswith(b"WARC/"):
            raise ValueError(f"record {count} has no version line")
        head = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.lower()] = v.strip()
        length = int(head["content-length"])
        block = archive.read(length)
        if len(block) < length or archive.read(4) not in (b"\r\n\r\n", b""):
            raise ValueError(f"record {count} doesn't end where its length says")
        kind, body, fields = head["warc-type"], None, {}
        size, digest = None, None
        if kind in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
            if kind == "response":
                size, digest = len(body), hashlib.sha1(body).hexdigest()
                if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                    raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
            else:
                size, digest, body = int(fields["content-length"]), head["warc-payload-digest"].partition(":")[2], None
        elif kind == "metadata":
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
        else:
            body = block
        yield {"record_id": head["warc-record-id"], "record_type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"), "fields": list(fields.items()), "payload_bytes": size, "payload_digest": digest, "payload": body}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. ``with_payload`` false leaves the payload out once it has been counted and hashed."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse(opened(content.as_py())):
                    held += len(r["payload"] or b"") + 500
                    if not with_payload:
                        r["payload"] = None
                    rows.append(r)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: requests, the response and metadata that name it in ``concurrent_to``.

    Records whose response is missing still give a row, with a null response.
    """
    one = F.struct("record_id", "record_type", "target_uri", "warc_date", "refers_to", "fields", "payload_bytes", "payload_digest", "payload")
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(F.array_sort(F.collect_list(F.struct("record_id", "record_type", one.alias("r"))), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("all"))
    of = lambda *kinds: F.transform(F.filter("all", lambda x: x["record_type"].isin(*kinds)), lambda x: x["r"])
    return grouped.select("capture_id", of("request").alias("requests"), F.get(of("response", "revisit"), F.lit(0)).alias("response"), of("metadata").alias("metadata"))


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return assemble(read_archives(spark, path, with_payload))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = captures(spark, path, with_payload=False).select(
        "capture_id",
        F.element_at(F.get("metadata", F.lit(0))["fields"], "page-id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
    )
    found = keep(found, "captures")
    plain = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = found.where("record_type = 'revisit'").join(found.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")), "target", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*out).unionByName(again.select(*out))


QUERIES = {"op9_warc": op9}
ORACLES = {
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN r USING (d)
"""
}
