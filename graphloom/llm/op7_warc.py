"""WARC archives with a Zstandard dictionary in a leading skippable frame.

A dictionary is trained from a bounded sample of the records themselves.  Each
archive starts with a skippable frame (magic 0x184D2A5D) that holds it; every
record is then a frame of its own, so a record can be read by its offset with
nothing but the archive's head.  Records whose payload of 1000 bytes or more another
record has become revisits of the one with the largest page_id.

Defined cases: null html is an empty payload; a null url is empty, a null page_id
is written as ``null``; of repeated rows one is the response, the others revisit it;
an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DICTIONARY_FRAME = 0x184D2A5D
LEAST_REVISIT = 1000
ARCHIVES = "data binary"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, with the two line ends after its block."""
    url = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{'null' if refers_to is None else refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if found == "null" else int(found)


def records(data: bytes) -> Iterator[tuple]:
    """Read an archive: the rows of RECORDS, payload digests verified."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("a payload does not match its digest")
        yield _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head["WARC-Refers-To"]) if revisit else None, head["WARC-Target-URI"]


def _write(batches: Iterator[pa.RecordBatch], dictionary: bytes, date: str, most: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    out, size = [head], 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["data"])
    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("page_id", "url", "refers_to", "revisit")]
        for html, page_id, url, refers_to, revisit in zip(batch["html"], *cols, strict=True):
            frame = press.compress(record(page_id, url, (html.as_py() or "").encode(), refers_to, revisit, date))
            if size and size + len(frame) > most:
                yield done()
                out, size = [head], 0
            out.append(frame)
            size += len(frame)
    if size:
        yield done()


def _dictionary(pages: DataFrame, date: str, most: int = 1500, longest: int = 32_768) -> bytes:
    """Trained from the records of at most ``most`` pages of at most ``longest`` bytes; empty if they are too few."""
    rows = pages.select("page_id", "url", "html").where(F.octet_length("html") <= longest).limit(most).collect()
    try:
        return zstandard.train_dictionary(64 << 10, [record(r[0], r[1], r[2].encode(), None, False, date) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 16 << 20) -> None:
    """Write the pages as archives: a table at ``path`` with one archive's bytes in each row."""
    pages = C.numbered(C.clean(pages, "page_id", "url", "html").withColumn("text", F.lit(None).cast("string")))
    pages = pages.select("rid", F.col("row.page_id").cast("bigint").alias("page_id"), F.col("row.url").alias("url"), F.col("row.html").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.withColumn("large", F.octet_length(payload) >= LEAST_REVISIT)
    # digests move, payloads of unique pages are only joined with what their digest says
    large = pages.where("large").select("rid", "page_id", F.sha1(payload).alias("digest"))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.col("rid")).alias("r"))
    best = large.groupBy("digest").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = large.join(best, "digest").where(F.col("rid") != -F.col("best.r")).select("rid", F.col("best.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    marked = pages.join(again, "rid", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False))).select("page_id", "url", "html", "refers_to", "revisit")
    dictionary = _dictionary(pages, date)
    marked.mapInArrow(lambda it: _write(it, dictionary, date, archive_bytes), ARCHIVES).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for data in batch["data"]:
            rows = list(records(data.as_py()))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names=names)


def read(spark, path: str) -> DataFrame:
    """The records of all archives of a table that ``write`` made."""
    return spark.read.schema(ARCHIVES).parquet(path).mapInArrow(_read, RECORDS)


def export(spark, path: str, folder: str) -> int:
    """Copy the archives one by one into a local folder as ``.warc.zst`` files; returns how many."""
    n = 0
    for n, row in enumerate(spark.read.schema(ARCHIVES).parquet(path).toLocalIterator(), 1):
        with open(f"{folder}/{n:06d}.warc.zst", "wb") as out:
            out.write(row["data"])
    return n


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the records of all pages, from the written archives."""
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(C.table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id,
         row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN last_id END AS refers_to
FROM w
"""
