"""Benchmark decontamination by binary search in suffix arrays of the training text.

Each shard (a run of documents inside one Spark partition) gets a word-level
suffix array of its whole texts: suffixes are ordered by their leading words,
packed as ranks of the benchmark's vocabulary.  Every test suffix is then
searched by bisection, in all shards, which yields where it occurs and how far
the verbatim match reaches.  The documents are only scanned, never shuffled.

The benchmark's items are cut into pieces of bounded size by Spark, and the pieces are
dealt into blocks of about ``BLOCK`` windows; each block is broadcast alone, as flat arrays,
and takes one pass over the documents, so a larger benchmark costs more passes,
never a larger broadcast, and a long item is many pieces.  Occurrences of windows that
follow each other both in an item and in a document are one verbatim match, as far as a piece goes.

Defined cases: null or wordless texts have no words, no hits and stay; empty
items have no windows; an item without an id is named by the empty string; items of
the same id count as one; an empty benchmark contaminates nothing; repeated rows
are annotated one by one; null doc_id stays null; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all non-ASCII.
WORD = C.byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
SHARD_BYTES = 1 << 19
#: Windows of a block (about) and of a piece of an item.
BLOCK, PIECE = 1 << 20, 1 << 16
PIECES = "item string, first bigint, hashes binary"


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the offset of each row's first word."""
    raw = C.lower_ascii(raw)
    start, end, words_at = C.words_of(raw, at, WORD)
    return C.words_hash(raw, start, end), words_at


class TestSet:
    """The windows of one block of benchmark pieces, ready to be searched for: flat arrays only."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str, int, np.ndarray]], n: int) -> None:
        """pieces: (item id, first word, word hashes); n: words of a window."""
        self.n = n
        self.ids, item = np.unique(np.array([i for i, _, _ in pieces], dtype=object).astype(str), return_inverse=True) if pieces else (np.empty(0, str), np.empty(0, np.int64))
        size = np.array([len(h) for _, _, h in pieces], np.int64)
        hashes = np.concatenate([h for _, _, h in pieces]) if pieces else np.empty(0, np.uint64)
        self.vocabulary = np.unique(hashes)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = max(1, 63 // self.bits)
        self.keys = math.ceil(n / self.per_key)
        # ranks, with n - 1 zeros behind each piece
        at = np.cumsum(size + n - 1) - size - (n - 1)
        ranks = np.zeros(int((size + n - 1).sum()) + n, np.int64)
        place = np.arange(len(hashes)) + np.repeat(at - (np.cumsum(size) - size), size)
        ranks[place] = np.searchsorted(self.vocabulary, hashes) + 1
        many = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        own = np.repeat(np.arange(len(pieces)), many)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        words = np.lib.stride_tricks.sliding_window_view(ranks, n)[(at[own] + start)] if len(own) else np.zeros((0, n), np.int64)
        low = self._pack(words)
        order = np.lexsort(low[::-1]) if len(own) else np.empty(0, np.int64)
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in low], axis=0)
        window = np.cumsum(new) - 1
        first = order[new]
        # occurrences in the benchmark, ordered by window
        self.at = np.append(np.flatnonzero(new), len(order))
        self.item = item[own[order]].astype(np.int64)
        self.piece = own[order]
        self.place = np.array([f for _, f, _ in pieces], np.int64)[own[order]] + start[order] if len(order) else np.empty(0, np.int64)
        pairs = np.unique(np.stack([window, self.item]), axis=1) if len(order) else np.empty((2, 0), np.int64)
        self.pair_item, self.pair_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1))
        self.lengths = np.minimum(size[own[first]], n)
        self.count = int(window[-1]) + 1 if len(window) else 0
        self.low = [k[first] for k in low]
        # words behind a short item may be any
        high = np.where(np.arange(n) < self.lengths[:, None], words[first], (1 << self.bits) - 1) if len(first) else words
        self.high = self._pack(high)
        self.lead = words[first, 0] if len(first) else np.empty(0, np.int64)
        self.leads = np.zeros(len(self.vocabulary) + 2, bool)
        self.leads[self.lead] = True

    def _pack(self, words: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(self.keys):
            key = np.zeros(len(words), np.int64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << self.bits) | (words[:, j] if j < self.n else 0)
            out.append(key)
        return out

    def suffix_array(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of one shard: (word ranks with an end mark after each row, sorted keys, suffix starts in order, row starts)."""
        rows = len(at) - 1
        begins = at[:-1] + np.arange(rows)
        ranks = np.zeros(len(hashes) + rows + self.n, np.int64)
        if len(self.vocabulary) and len(hashes):
            near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            found = np.where(self.vocabulary[near] == hashes, near + 1, 0)
            ranks[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(at))] = found
        starts = np.flatnonzero(self.leads[ranks])  # no test suffix starts with any other word
        keys = []
        for k in range(self.keys):
            key = np.zeros(len(starts), np.int64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << self.bits) | (ranks[starts + j] if j < self.n else 0)
            keys.append(key)
        order = np.lexsort(keys[::-1]) if len(starts) else np.empty(0, np.int64)
        return ranks, [k[order] for k in keys], starts[order], begins

    @staticmethod
    def bisect(keys: list[np.ndarray], sought: list[np.ndarray], after: bool) -> np.ndarray:
        """For each sought key the first place not before it (after: the first place behind it)."""
        lo = np.zeros(len(sought[0]), np.int64)
        hi = np.full(len(sought[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(keys[0]) - 1)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, q in zip(keys, sought, strict=True):
                less |= same & (k[at] < q)
                same &= k[at] == q
            if after:
                less |= same
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def occurrences(self, keys: list[np.ndarray], starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of every window in the shard."""
        here = np.zeros(len(self.leads), bool)
        here[ranks[starts]] = True
        some = np.flatnonzero(here[self.lead])  # all others start with a word that the shard does not have
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo, hi = self.bisect(keys, [k[some] for k in self.low], False), self.bisect(keys, [k[some] for k in self.high], True)
        n = hi - lo
        which = np.repeat(some, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return which, starts[place]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The different items that any of the windows occurs in."""
        many = np.diff(self.pair_at)[windows]
        of = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.pair_at[windows], many)
        return np.unique(self.pair_item[of])

    def matches(self, which: np.ndarray, where: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, item_start, doc, start, n_words) of the longest verbatim matches that the occurrences make up."""
        many = np.diff(self.at)[which]
        of = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.at[which], many)
        p, d, j, m = np.repeat(where, many), np.repeat(doc, many), self.place[of], np.repeat(self.lengths[which], many)
        order = np.lexsort((p, p - j, self.piece[of], d))
        p, d, j, m, of = p[order], d[order], j[order], m[order], of[order]
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(p) != 1) | (np.diff(j) != 1) | (np.diff(d) != 0) | (np.diff(self.piece[of]) != 0)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(p)))
        return self.item[of[first]], j[first], d[first], p[first], run - 1 + m[first]


def _cut_items(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE windows; neighbours share n - 1 words."""
    for batch in batches:
        ids = batch["item_id"].cast(pa.string()).to_pylist()
        raw, at = C.text_buffer(batch["text"])
        for i, item in enumerate(ids):
            hashes, _ = word_hashes(raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
            for a in range(0, max(len(hashes) - n + 1, min(len(hashes), 1)), PIECE):
                cut = hashes[a : a + PIECE + n - 1]
                yield pa.RecordBatch.from_arrays([pa.array([item or ""]), pa.array([a]), pa.array([cut.astype("<u8").tobytes()], pa.binary())], names=["item", "first", "hashes"])


def blocks(bench: DataFrame, n: int, block: int | None = None) -> Iterator[TestSet]:
    """The benchmark as test sets of about ``block`` windows; only the word hashes of one reach the driver at a time."""
    block = block or BLOCK
    pieces = C.clean(bench, "item_id", "text").mapInArrow(lambda it: _cut_items(it, n), PIECES)
    pieces = C.stored(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    words = pieces.agg(F.sum(F.octet_length("hashes")) / 8).first()[0] or 0
    many = max(1, math.ceil(words / block))
    for k in range(many):
        rows = pieces.where(F.pmod(F.xxhash64("id"), F.lit(many)) == k).select("item", "first", "hashes").collect()
        if rows:
            yield TestSet([(r[0], r[1], np.frombuffer(r[2], "<u8").astype(np.uint64)) for r in rows], n)


def annotate(docs: DataFrame, bench: DataFrame, n: int = 10, block: int | None = None) -> DataFrame:
    """One row for each document: ``row`` (all its columns), n_words, n_hit, spans (hit word runs) and items."""
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    zero = F.lit(0).cast("bigint")
    df = docs.select(F.struct("*").alias("row"))
    df = df.select("row", zero.alias("n_words"), zero.alias("n_hit"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    shared = None
    for tests in blocks(bench, n, block):
        if shared is not None:
            df = C.stored(df, "decontaminate")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(tests)
        df = df.mapInArrow(lambda it, shared=shared: _pass(it, shared.value), df.schema)
    if shared is None:  # nothing to search for; words are counted all the same
        df = df.mapInArrow(lambda it: _pass(it, TestSet([], n)), df.schema)
    return df


def _pass(batches: Iterator[pa.RecordBatch], tests: TestSet) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in C.pieces(batch, SHARD_BYTES):
            hashes, words_at = word_hashes(raw, at)
            ranks, keys, starts, begins = tests.suffix_array(hashes, words_at)
            which, where = tests.occurrences(keys, starts, ranks)
            n_words = np.diff(words_at)
            spans, items = part["spans"].to_pylist(), part["items"].to_pylist()
            doc = np.searchsorted(begins, where, "right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d
                s = where[own] - begins[d]
                runs = [(x["s"], x["e"]) for x in spans[d]] + list(zip(s.tolist(), (s + tests.lengths[which[own]]).tolist(), strict=True))
                spans[d] = merged(runs)
                items[d] = sorted({*items[d], *tests.ids[tests.items_of(np.unique(which[own]))].tolist()})
            n_hit = [sum(x["e"] - x["s"] for x in y) for y in spans]
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, part[f.name]) for f in batch.schema], schema=batch.schema)


def merged(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping or touching runs as one, in order."""
    out: list[dict[str, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], e)
        else:
            out.append({"s": s, "e": e})
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    return annotate(docs, bench, n).where(F.col("n_hit") == 0).select("row.*")


def longest_matches(docs: DataFrame, bench: DataFrame, n: int = 10, block: int | None = None) -> DataFrame:
    """For every test suffix that matches somewhere: its longest verbatim match and the first place of it.

    Columns item_id (string), item_start, n_words, doc_id, doc_start; starts count
    words.  Matches shorter than a window are not listed, nor those in documents without an id.
    """
    spark = docs.sparkSession
    schema = "item_id string, item_start bigint, n_words bigint, doc_id bigint, doc_start bigint"
    found = spark.createDataFrame([], schema)
    for tests in blocks(bench, n, block):
        shared = spark.sparkContext.broadcast(tests)
        found = found.unionByName(C.stored(C.clean(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(lambda it, shared=shared: _longest(it, shared.value), schema), "matches"))
        shared.unpersist()
    # a match that starts earlier in the item holds those of the suffixes behind
    each = found.select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("n_words") - n))).alias("i"), "item_start", "n_words", "doc_id", "doc_start")
    each = each.select("item_id", (F.col("item_start") + F.col("i")).alias("item_start"), (F.col("n_words") - F.col("i")).alias("n_words"), "doc_id", (F.col("doc_start") + F.col("i")).alias("doc_start"))
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("b")
    return each.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", "b.n_words", (-F.col("b.d")).alias("doc_id"), (-F.col("b.s")).alias("doc_start"))


def _longest(batches: Iterator[pa.RecordBatch], tests: TestSet) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in C.pieces(batch, SHARD_BYTES):
            ids = part["doc_id"].cast(pa.int64()).to_numpy()
            hashes, words_at = word_hashes(raw, at)
            ranks, keys, starts, begins = tests.suffix_array(hashes, words_at)
            which, where = tests.occurrences(keys, starts, ranks)
            item, j, d, p, size = tests.matches(which, where, np.searchsorted(begins, where, "right") - 1)
            if len(item):
                yield pa.RecordBatch.from_arrays([pa.array(tests.ids[item].tolist(), pa.string()), *(pa.array(x, pa.int64()) for x in (j, size, ids[d], p - begins[d]))], names=["item_id", "item_start", "n_words", "doc_id", "doc_start"])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``annotate`` over all documents."""
    rows = annotate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: What SQL would need here is a correlated n-gram search; the brute-force test stands in.
SQL = None
