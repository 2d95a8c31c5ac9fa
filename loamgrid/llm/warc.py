"""Web archives whose repeated payloads are revisit records.

Headers (ids, digests, lengths) are shuffled by payload digest; each repeated
payload is written once, as the response with the largest id, and the others
become revisit records that name it. Archives are written by Spark's own text
writer, whose line separator is the two line ends that close a WARC record, so
they go wherever Spark can write, and tasks that are run again leave no half
files. Reading follows the records' lengths, not their text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.session import checkpoint_dir, durable

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Records in an archive file.
FILE_RECORDS = 1000
#: Revisits up to this number (a few tens of MB) are broadcast to the pages; more are joined by shuffle.
BROADCAST_ROWS = 300_000
END = "\r\n\r\n"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, stored_bytes long"


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), payload_bytes, payload_digest."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))


def find_revisits(payloads: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload a page with a larger id has."""
    headers = payloads.where(F.col("payload_bytes") >= LEAST_BYTES).select("page_id", "payload_digest", "payload_bytes")
    originals = headers.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    return headers.join(originals, ["payload_digest", "payload_bytes"]).where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def record_id(page_id: Column, digest: Column) -> Column:
    x = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header_safe(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "\r", "%0D"), "\n", "%0A")


def records(payloads: DataFrame) -> Column:
    """The text of a WARC record, without the line ends that close it. Needs refers_to."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.concat(F.lit("WARC-Date: "), now),
        F.concat(F.lit("WARC-Target-URI: "), header_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http, F.when(revisit, "").otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record for each row of ``pages(page_id, url, html)`` to gzipped archives in ``path``.

    A null html is an empty payload; a null url is written empty, and a null
    page_id as none. Rows that repeat a page_id and a payload repeat its record.
    """
    payloads = with_payload(pages)
    revisits = durable(find_revisits(payloads))
    small = revisits.count() <= BROADCAST_ROWS
    joined = payloads.join(F.broadcast(revisits) if small else revisits, ["page_id", "payload_digest"], "left")
    joined.select(records(joined).alias("value")).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


class Stream:
    """Bytes of a gzipped or plain archive, unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.unpack = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.buffer = b""

    def _more(self) -> bool:
        if self.unpack is not None and self.unpack.eof and self.unpack.unused_data:
            rest = self.unpack.unused_data
            self.at -= len(rest)
            self.unpack = zlib.decompressobj(31)
        chunk = self.data[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        if not chunk:
            return False
        self.buffer += self.unpack.decompress(chunk) if self.unpack is not None else chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out, self.buffer = self.buffer[:k], self.buffer[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self._more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    stream = Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, stream.take(int(headers["content-length"]))
        stream.take(4)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of headers for each record in the archives of ``path``, its digest and lengths found anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in parse_archive(data.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind = headers["warc-type"]
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else stated
                    if digest != stated:
                        raise ValueError(f"payload of {headers['warc-record-id']} has another digest than its header")
                    page = headers.get("x-page-id")
                    rows.append((int(page) if page else None, kind, len(payload) if kind == "response" else None, digest, len(payload)))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Give each revisit record its original response and that one's payload length.

    ``found``: rows of :func:`read_archives`. The original is the response with
    the same digest, of those of at least LEAST_BYTES.
    """
    whole = found.where("record_type = 'response'")
    originals = whole.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.max("payload_bytes").alias("original_bytes"))
    revisits = found.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to")))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return resolve_revisits(durable(read_archives(spark, path)))


#: The contract in SQL, from the pages themselves.
OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM g
"""
