"""Best-fit decreasing packing of token sequences.

Documents are cut into pieces of at most one window (2048 tokens).  By falling length,
each piece goes into the open bin with the least room that still takes it, or into a
new one; a segment tree over the remaining capacities finds that bin in a logarithmic
number of steps.

A length is one of at most 2048, so the decisions need the number of pieces of each
length alone: bins with the same room are one entry of the tree, a run of numbers, and
equal pieces go into a run together.  The plan is the one that best-fit decreasing makes
piece by piece over all documents; its size depends on the lengths and not on
the number of documents, and so do the driver's memory and the broadcast.  Pieces learn their rank
among those of their length from counts of each task, and find their bin by bisection.

Defined cases: null or empty texts are one piece, the end id; repeated rows are packed
one by one; ties of equal lengths are broken by where the rows stand; an empty table gives no rows; other columns are
not read; null doc_id stays null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .tokens import WordEncoder, encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: Tasks whose counts are summed up together, before the sums of these groups.
GROUP = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Rooms:
    """A segment tree over capacities 0 .. size: which capacities have open bins."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        #: room -> runs of bins: (first bin, number of bins)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _set(self, room: int, value: bool) -> None:
        at = room + self.leaves
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def put(self, room: int, first: int, bins: int) -> None:
        self.runs.setdefault(room, []).append((first, bins))
        if not self.any[room + self.leaves]:
            self._set(room, True)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """At most so many bins of one run with this room."""
        runs = self.runs[room]
        first, bins = runs.pop()
        if bins > most:
            runs.append((first + most, bins - most))
            bins = most
        if not runs:
            self._set(room, False)
        return first, bins

    def tightest(self, length: int) -> int | None:
        """The least room of an open bin that takes ``length``: up from its leaf, then down to the left."""
        at = length + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset) for runs of equal pieces, ordered by length and rank.

    counts: length -> number of pieces.  Piece ``first rank + i`` goes to bin ``first bin + i``.
    """
    rooms, made, out = Rooms(size), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room = size
                bins = -(-left // (size // length))
                rooms.put(size, made, bins)
                made += bins
            # a bin that took one piece has less room than all others: it goes on until it is too tight
            each = room // length
            first, bins = rooms.take(room, max(1, left // each))
            each = min(each, left)
            for k in range(each):
                out.append((length, rank, first, size - room + k * length))
                rank, left = rank + bins, left - bins
            rooms.put(room - each * length, first, bins)
    return np.array(sorted(out), np.int64).reshape(-1, 4)


@C.tidy
def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    enc, part, rank = encoder(path, WordEncoder), TaskContext.get().partitionId(), Counter()
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    schema = [x.split() for x in PIECES.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)], names=[n for n, _ in schema])

    out: list[tuple] = []
    for batch in batches:
        for doc, ids in enc.documents(batch, end_id):
            for k, start in enumerate(range(0, len(ids), size)):
                cut = ids[start : start + size].astype("<u4").tobytes()
                n = len(cut) // 4
                out.append((doc, k, start, n, C.crc32(cut), part, rank[n]))
                rank[n] += 1
            if len(out) > 20_000:
                yield rows(out)
                out = []
    if out:
        yield rows(out)


def _place(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    rows = table.value
    lengths = rows[:, 0]
    for batch in batches:
        length = batch["length"].to_numpy()
        rank = batch["rank"].to_numpy() + batch["base"].to_numpy()
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):  # the plan's rows of one length stand together, by rank
            a, b = np.searchsorted(lengths, [n, n + 1])
            own = length == n
            at[own] = a + np.searchsorted(rows[a:b, 1], rank[own], "right") - 1
        found = rows[at]
        cols = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PLACED.split(", ")])


def pack_best_fit(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path, spark = path or default_path(), docs.sparkSession
    pieces = C.stored(C.clean(docs, "doc_id", "text").mapInArrow(lambda it: _cut(it, path, end_id, size), PIECES), "pieces")
    # pieces of a length in the tasks before: sums within groups of tasks, then of the groups
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.floor(F.col("part") / GROUP))
    before = lambda of, by: F.coalesce(F.sum("n").over(W.partitionBy(*of).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = held.groupBy("length", "many").agg(F.sum("n").alias("n")).select("length", "many", before(["length"], "many").alias("ahead"))
    bases = held.select("part", "length", "many", before(["length", "many"], "part").alias("within")).join(groups, ["length", "many"])
    bases = bases.select("part", "length", (F.col("within") + F.col("ahead")).alias("base"))
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length, at most ``size``
    table = spark.sparkContext.broadcast(plan(counts, size))
    return pieces.join(bases, ["part", "length"]).mapInArrow(lambda it: _place(it, table), PLACED)


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    """Contract digest: the pieces themselves."""
    return pack_best_fit(C.table(spark, sf_dir, "documents"))


#: Subword tokenization has no SQL form; an exact round trip and a packing piece by piece stand in.
SQL = None
