"""Media columns as ordered lists of content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes matches a mask, so
equal stretches give equal chunks wherever they stand.  Tasks stage each chunk they
have not yet written, compressed; digests of all tasks are then deduplicated by
Spark joins, and a medium is the ordered list of its chunk digests.  Reading back
joins the lists with one copy of each chunk, checks every digest, and puts the
payload together again; media with the same list are read once.

Stored form of a medium: for each chunk in order, its 16-byte digest and its body as it
stands in the store (a Zstandard frame with the store's dictionary).  ``media_*`` are
taken from these bytes as they are read.

Defined cases: null counts as empty; an empty text is 64 zero bytes; repeated rows
share all chunks; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 64
LEAST, MASK_BITS, MOST = 2048, 13, 65536
#: Staged digests that a task remembers; beyond it, copies are left to the joins.
REMEMBERED = 200_000
STAGED = "rid bigint, doc_id bigint, n_bytes bigint, n int, seq int, digest binary, body binary"
FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
FEATURE_SCHEMA = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_GEAR = C.mix(np.arange(1, 257).astype(np.uint64)).astype(np.uint32)


def cuts(payload: np.ndarray) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    marks = []
    step = 4 << 20
    for at in range(0, n, step):
        begin = max(0, at - 31)
        h = _GEAR[payload[begin : at + step]]
        for k in (1, 2, 4, 8, 16):  # sum of gear values shifted by their age
            older = np.zeros_like(h)
            older[k:] = h[:-k] << np.uint32(k)
            h = h + older
        marks.append(np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1 + begin)
    where = np.unique(np.concatenate(marks))
    out, last = [], 0
    while n - last > LEAST:
        i = int(np.searchsorted(where, last + LEAST))
        end = int(where[i]) if i < len(where) else n
        last = min(end, last + MOST, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _stage(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    seen: set[bytes] = set()
    for batch in batches:
        for part, raw, at in C.pieces(batch, 4 << 20):
            cols: list[list] = [[] for _ in range(7)]
            rids, docs = part["rid"].to_pylist(), part["doc_id"].to_pylist()
            for i in range(part.num_rows):
                size = int(at[i + 1] - at[i])
                padded = max(UNIT, -(-size // UNIT) * UNIT)
                payload = np.zeros(padded, np.uint8)
                payload[:size] = raw[at[i] : at[i + 1]]
                ends, data, last = cuts(payload), payload.tobytes(), 0
                for seq, end in enumerate(ends):
                    chunk = data[last:end]
                    last = end
                    name = digest(chunk)
                    key = name + bytes([len(ends) > 1])
                    body = None
                    if key not in seen:
                        body = press.compress(chunk)
                        if len(seen) < REMEMBERED:
                            seen.add(key)
                    for c, v in zip(cols, (rids[i], docs[i], size, len(ends), seq, name, body), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in STAGED.split(", ")])


def _medium(stored: list[tuple[bytes, bytes]], reader: zstandard.ZstdDecompressor) -> tuple:
    """Features of a medium from its digests and bodies, in the order of FEATURES; chunks are verified."""
    chunks = [_open(body, name, reader) for name, body in stored]
    payload = b"".join(chunks)
    medium, size = hashlib.sha256(), 0
    for name, body in stored:
        medium.update(name)
        medium.update(body)
        size += len(name) + len(body)
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum())
    feature = f"chunks={len(chunks)};mean={int(counts @ np.arange(256)) / len(samples):.4f};max={int(samples.max())};entropy={entropy:.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), C.crc32(payload[-64:]), size, medium.hexdigest(), feature


def _open(body: bytes, name: bytes, reader: zstandard.ZstdDecompressor) -> bytes:
    chunk = reader.decompress(body)
    if digest(chunk) != name:
        raise ValueError("a stored chunk does not match its digest")
    return chunk


def _read(batches: Iterator[pa.RecordBatch], dictionary: bytes, key: str) -> Iterator[pa.RecordBatch]:
    """Put media together from ``chunks`` (seq, digest, body) or from single chunks, and compute features."""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for batch in batches:
        out = []
        if key == "digest":
            for name, body in zip(batch["digest"], batch["body"], strict=True):
                out.append(_medium([(name.as_py(), body.as_py())], reader))
        else:
            for chunks in batch["chunks"]:
                out.append(_medium([(x["digest"].as_py(), x["body"].as_py()) for x in chunks], reader))
        if out:
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), FEATURES, strict=True))], names=[key, *(n for n, _ in FEATURES)])


def _dictionary(docs: DataFrame, most: int = 2000, longest: int = 8192) -> bytes:
    """A compression dictionary from at most ``most`` different texts of middle length; without one, chunks compress alone.

    The texts of least hash are taken, so that the same table gives the same stored bytes.
    """
    rows = C.clean(docs, "text").where(F.octet_length("text").between(512, longest)).select(F.xxhash64("text").alias("h"), "text")
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]
    if not least:
        return b""
    texts = rows.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text")).collect()
    try:
        return zstandard.train_dictionary(64 << 10, [r["text"].encode() for r in sorted(texts)]).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


class ChunkStore:
    """Staged chunks of a table's texts, and their way back."""

    def __init__(self, docs: DataFrame) -> None:
        self.dictionary = _dictionary(docs)
        rows = C.numbered(C.clean(docs, "doc_id", "text")).select("rid", F.col("row.doc_id").cast("bigint").alias("doc_id"), "text")
        self.staged = C.stored(rows.mapInArrow(lambda it, d=self.dictionary: _stage(it, d), STAGED), "chunks")

    def directory(self) -> DataFrame:
        """digest and how many media places refer to it: the deduplicated chunk list."""
        return self.staged.groupBy("digest").agg(F.count(F.lit(1)).alias("places"))

    def media(self) -> DataFrame:
        """rid, doc_id, n_bytes, recipe (digest of the ordered chunk digests), names (the list)."""
        several = self.staged.where("n > 1").groupBy("rid", "doc_id", "n_bytes").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "digest"))), lambda x: x["digest"]).alias("names"))
        return several.withColumn("recipe", F.unhex(F.sha2(F.array_join(F.transform("names", F.hex), ","), 256)))

    def features(self) -> DataFrame:
        """doc_id, n_bytes and the features of each medium, from the bytes read back."""
        read = lambda df, key: df.mapInArrow(lambda it, d=self.dictionary: _read(it, d, key), f"{key} binary, {FEATURE_SCHEMA}")
        columns = ["doc_id", "n_bytes", *(n for n, _ in FEATURES)]
        # media of one chunk are read where the chunk stands; only the features move
        one = C.stored(read(self.staged.where("n = 1 AND body IS NOT NULL").select("digest", "body"), "digest"), "single").dropDuplicates(["digest"])
        singles = self.staged.where("n = 1").select("doc_id", "n_bytes", "digest").join(one, "digest").select(*columns)
        media = C.stored(self.media(), "media")
        recipes = media.groupBy("recipe").agg(F.min("rid").alias("rid"))
        lists = media.join(recipes, ["recipe", "rid"]).select("recipe", F.posexplode("names").alias("seq", "digest"))
        bodies = self.staged.where("n > 1 AND body IS NOT NULL").select("digest", "body").dropDuplicates(["digest"])
        whole = lists.join(bodies, "digest").groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "body"))).alias("chunks"))
        return singles.unionByName(media.join(read(whole, "recipe"), "recipe").select(*columns))


def op3_chunks(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the media of all documents, read back from the chunk store."""
    return ChunkStore(C.table(spark, sf_dir, "documents")).features()


#: Gear-hash cuts and the stored form have no SQL; an exact round trip stands in.
SQL = None
