"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A piece goes into the open
window that it fills best; if none has room, the fullest is emitted and a fresh
one opened.  What is still open at the end of the partitions is merged: whole
windows are put together, best fit by falling fill, in groups of bounded size.
No text and no ids are shuffled, and all but the last merge is one pass.  ``sequences``
puts the ids of packed pieces together, where they are wanted.

Defined cases: null or empty texts are one piece, the end id; repeated rows are
packed one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import default_path, encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, win bigint, offset bigint, fill bigint, open boolean"
IDS = ", ids binary"


class Windows:
    """The open windows of one partition, ordered by the room they have left."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.made = size, most, 0
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list[tuple]] = {}

    def place(self, piece: tuple, length: int) -> list[tuple]:
        """Put a piece where it fits best; returns the pieces of a window emitted for it."""
        out: list[tuple] = []
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                out = self._emit(*self.open.pop(0), False)
            room, number = self.size, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((*piece, number, self.size - room))
        room -= length
        if room:
            bisect.insort(self.open, (room, number))
        else:
            out = out + self._emit(0, number, False)
        return out

    def _emit(self, room: int, number: int, still_open: bool) -> list[tuple]:
        return [(*p, self.size - room, still_open) for p in self.held.pop(number)]

    def rest(self) -> list[tuple]:
        out = [p for room, number in self.open for p in self._emit(room, number, True)]
        self.open = []
        return out


@C.tidy
def _place(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, most: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, windows, part = encoder(path), Windows(size, most), TaskContext.get().partitionId()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "win", "offset", "fill", "open"]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = dict(zip(names, zip(*out, strict=True), strict=True)) | {"part": [part] * len(out)}
        kinds = [x.split() for x in (PIECES + IDS * with_ids).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(cols[n], {"boolean": pa.bool_(), "binary": pa.binary()}.get(t, pa.int64())) for n, t in kinds], names=[n for n, _ in kinds])

    out: list[tuple] = []
    for batch in batches:
        for doc, ids in enc.documents(batch, end_id):
            for start in range(0, len(ids), size):
                cut = ids[start : start + size].astype("<u4").tobytes()
                out += windows.place((doc, start, len(cut) // 4, C.crc32(cut), len(ids), *[cut] * with_ids), len(cut) // 4)
            if len(out) > 20_000:
                yield rows(out)
                out = []
    if out := out + windows.rest():
        yield rows(out)


def _merge(size: int):
    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        """Best fit by falling fill of whole windows; one group of bounded size."""
        left = left.sort_values(["fill", "part", "win"], ascending=[False, True, True])
        rooms: list[tuple[int, int]] = []
        number, base = [], []
        made = 0
        for fill in left["fill"]:
            at = bisect.bisect_left(rooms, (fill, -1))
            room, to = rooms.pop(at) if at < len(rooms) else (size, made)
            made = max(made, to + 1)
            number.append(to)
            base.append(size - room)
            if room > fill:
                bisect.insort(rooms, (room - fill, to))
        return left.assign(number=number, base=base, bucket=int(key[0]))[["part", "win", "bucket", "number", "base"]]

    return merge


def pack(docs: DataFrame, size: int = 2048, open_windows: int = 64, end_id: int = 1, path: str | None = None, group: int = 2000, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    group: leftover windows that are merged together, about.  with_ids: also ids, the
    piece's ids as little-endian unsigned 32-bit numbers.
    """
    path = path or default_path()
    pieces = C.stored(C.clean(docs, "doc_id", "text").mapInArrow(lambda it: _place(it, path, end_id, size, open_windows, with_ids), PIECES + IDS * with_ids), "pack")
    left = pieces.where("open").select("part", "win", "fill").distinct()
    buckets = max(1, math.ceil(pieces.where("open").agg(F.count_distinct("part", "win")).first()[0] / group))
    merged = left.withColumn("bucket", F.pmod(F.xxhash64("part", "win"), F.lit(buckets))).groupBy("bucket").applyInPandas(_merge(size), "part bigint, win bigint, bucket bigint, number bigint, base bigint")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    full = pieces.where("NOT open").withColumn("sequence_id", F.shiftleft("part", 31) + F.col("win"))
    rest = pieces.where("open").join(merged, ["part", "win"]).withColumn("offset", F.col("offset") + F.col("base"))
    rest = rest.withColumn("sequence_id", F.lit(1 << 62) + F.shiftleft("bucket", 31) + F.col("number"))
    return full.select(*columns).unionByName(rest.select(*columns))


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: each sequence's ids, padded to ``size``; pieces: of ``pack`` with their ids.

    A group is one sequence, at most ``size`` ids in at most ``size`` pieces.
    """
    pad = pad_id.to_bytes(4, "little")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(ordered.alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    n = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    padding = F.unhex(F.repeat(F.lit(pad.hex()), (F.lit(size) - F.col("n_tokens")).cast("int")))
    return whole.select("sequence_id", n.alias("n_tokens"), ids.alias("ids")).withColumn("ids", F.concat("ids", padding))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    """Contract digest: the pieces themselves."""
    return pack(C.table(spark, sf_dir, "documents"))


#: Subword tokenization has no SQL form; an exact round trip stands in.
SQL = None
