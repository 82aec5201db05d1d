"""Re-Pair grammar compression of token ids, in shards with random access.

Documents are range-partitioned by doc_id and encoded in order.  Each shard of about
``shard_ids`` ids gets its own grammar: frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again, until no pair occurs often enough to pay
for its rule.  A round takes all pairs that are nearly as frequent as the most
frequent one; where two of them overlap, the more frequent one goes first.

File format (little-endian): the header ``RPR2`` with five unsigned 32-bit numbers
(documents, distinct ids, rules, symbols, bytes of a symbol); for each document its
number of ids and of symbols (unsigned 32-bit); the distinct ids in ascending order
(unsigned 32-bit); the rules, two symbols each; their expansion lengths (unsigned
32-bit); the symbols.  Symbols below the number of distinct ids stand for those, the
others for rules.  A document's symbols are found from the counts, and any id inside
it from the expansion lengths.

Defined cases: null or empty texts are the end id alone; documents come in ascending
doc_id, null first, and repeated doc_ids in order of their texts; an empty table
gives no shards; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .tokens import default_path, encoder

MAGIC = b"RPR2"
#: A rule takes eight bytes and each use of it saves two, so that five uses pay.
LEAST = 5
#: A round takes pairs down to this part of the top count; slots (as a power of two) of the pairs it looks up.
NEARLY, SLOTS = 64, 18
SHARDS = "part int, shard int, ids bigint, earlier bigint, doc_ids array<bigint>, payload binary"


def grammar(ids: np.ndarray, end: int, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): the ids with frequent pairs replaced; rule i stands for symbol base + i.  ``end`` is never paired.

    A pair that is rare once stays rare, as counts of pairs of known symbols only
    fall.  So each round counts the places that may still be frequent: those of
    frequent pairs, and those beside new nonterminals.
    """
    s, rules, made = ids, [np.empty((0, 2), np.int64)], 0
    slots = np.zeros(1 << SLOTS, np.int32)
    alive = np.ones(len(s), bool)  # places whose pair may be frequent
    alive[-1:] = False
    while True:
        kind, bits = (np.uint32, 16) if base + made < 1 << 16 else (np.uint64, 32)  # narrow codes sort faster
        s = s.astype(kind, copy=False)
        live = np.flatnonzero(alive)
        left, right = s[live], s[live + 1]
        inside = (left != end) & (right != end)
        twins = np.flatnonzero(left == right)  # in a run of one symbol, every second place
        if len(twins):
            place = live[twins]
            begin = np.append(True, place[1:] != place[:-1] + 1)
            inside[twins[(place - place[begin][np.cumsum(begin) - 1]) % 2 == 1]] = False
        code = (left << kind(bits)) | right
        seen = np.sort(code[inside])
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])) if len(seen) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(seen)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        pairs = seen[first[often]]  # rank -> pair, most frequent first
        now = int(np.searchsorted(-count[often], -max(least, count[often[0]] // NEARLY), "right"))
        # the rank of the pair at each place; a pair whose slot a more frequent one has waits for the next round
        slot = lambda x: (x * kind(0x9E3779B1) >> kind(8 * kind().itemsize - SLOTS)).astype(np.int64)
        slots[:] = -1
        slots[slot(pairs)[::-1]] = np.arange(len(pairs) - 1, -1, -1)
        rank = slots[slot(code)]
        alive[live[rank < 0]] = False
        found = np.flatnonzero((rank >= 0) & (rank < now) & inside)
        found = found[pairs[rank[found]] == code[found]]
        at, rank = live[found], rank[found]
        # of overlapping pairs the more frequent one goes first
        near = at[1:] == at[:-1] + 1
        later = near & (rank[1:] < rank[:-1])
        beaten = np.append(later, False) | np.append(False, near & ~later)
        at, rank = at[~beaten], rank[~beaten]
        pays = np.bincount(rank, minlength=now) >= least  # the first does: nothing goes before it
        at, rank = at[pays[rank]], rank[pays[rank]]
        chosen = pairs[:now][pays]
        if base + made + len(chosen) > 1 << 16:
            s = s.astype(np.uint64)
        s[at] = base + made + (np.cumsum(pays) - 1)[rank]
        alive[at] = True
        alive[at[at > 0] - 1] = True
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, alive = s[keep], alive[keep]
        alive[-1] = False
        rules.append(np.stack([chosen >> kind(bits), chosen & kind((1 << bits) - 1)], axis=1).astype(np.int64))
        made += len(chosen)
    return s.astype(np.int64), np.concatenate(rules)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule; rules refer to earlier symbols only."""
    out = np.zeros(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    of = lambda x: np.where(x < base, 1, out[np.maximum(x - base, 0)])
    while todo.any():
        n = of(rules[:, 0]), of(rules[:, 1])
        ready = todo & (n[0] > 0) & (n[1] > 0)
        out[ready] = (n[0] + n[1])[ready]
        todo &= ~ready
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, one rule level after the other."""
    s = symbols.astype(np.int64)
    while (deep := s >= base).any():
        at = np.arange(len(s)) + np.cumsum(deep) - deep
        out = np.empty(len(s) + int(deep.sum()), np.int64)
        out[at[~deep]] = s[~deep]
        pair = rules[s[deep] - base]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s.astype(np.uint32)


def write_shard(docs: list[np.ndarray], end_id: int, least: int = LEAST) -> bytes:
    """One shard of the file format; docs: ids that end with end_id."""
    ids = np.concatenate(docs)
    present = np.zeros(int(ids.max()) + 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present)
    base = len(alphabet)
    symbols, rules = grammar((np.cumsum(present) - 1)[ids], int(np.searchsorted(alphabet, end_id)), base, least)
    length = lengths(rules, base)
    n = np.array([len(d) for d in docs], np.int64)
    # a document ends where its last id does; nonterminals never cross that end
    ends = np.cumsum(np.concatenate([np.ones(base, np.int64), length])[symbols])
    own = np.diff(np.concatenate([[0], np.searchsorted(ends, np.cumsum(n)) + 1]))
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = MAGIC + struct.pack("<5I", len(docs), base, len(rules), len(symbols), width)
    return head + np.stack([n, own], axis=1).astype("<u4").tobytes() + alphabet.astype("<u4").tobytes() + rules.astype(kind).tobytes() + length.astype("<u4").tobytes() + symbols.astype(kind).tobytes()


class Shard:
    """Reader of one shard."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        docs, self.base, rules, symbols, width = struct.unpack("<5I", data[4:24])
        at, kind = 24, f"<u{width}"
        self.counts = np.frombuffer(data, "<u4", 2 * docs, at).reshape(-1, 2).astype(np.int64)
        at += 8 * docs
        self.alphabet = np.frombuffer(data, "<u4", self.base, at)
        at += 4 * self.base
        self.rules = np.frombuffer(data, kind, 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * width * rules
        self.lengths = np.frombuffer(data, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.symbols = np.frombuffer(data, kind, symbols, at)
        self.starts = np.concatenate([[0], np.cumsum(self.counts[:, 1])])

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        return self.alphabet[expand(symbols, self.rules, self.base)]

    def all(self) -> np.ndarray:
        """All ids: the rules are expanded once, then every symbol is one copy."""
        own = np.flatnonzero(np.bincount(self.symbols, minlength=self.base + len(self.rules)))  # symbols that occur
        n = np.ones(self.base + len(self.rules), np.int64)
        n[self.base :] = self.lengths
        flat, start = self._ids(own), np.zeros(len(n), np.int64)
        start[own] = np.cumsum(n[own]) - n[own]
        size = n[self.symbols]
        return flat[np.arange(size.sum()) + np.repeat(start[self.symbols] - np.cumsum(size) + size, size)]

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, without decoding any other."""
        return self._ids(self.symbols[self.starts[i] : self.starts[i + 1]])

    def span(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of a document; only the symbols that cover them are expanded."""
        s = self.symbols[self.starts[i] : self.starts[i + 1]].astype(np.int64)
        n = np.where(s < self.base, 1, self.lengths[np.maximum(s - self.base, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(n)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop) + 1
        return self._ids(s[a:b])[start - (ends[a] - n[a] if a < len(s) else 0) :][: stop - start]


@C.tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
    docs: list[np.ndarray] = []
    names: list[int | None] = []
    held = earlier = 0

    def done() -> pa.RecordBatch:
        rows = [[part], [shard], [held], [earlier], [names], [write_shard(docs, end_id)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["part", "shard", "ids", "earlier", "doc_ids", "payload"])

    for batch in batches:
        for doc, ids in enc.documents(batch, end_id):
            docs.append(ids)
            names.append(doc)
            held += len(ids)
            if held >= shard_ids:
                yield done()
                docs, names, held, earlier, shard = [], [], 0, earlier + held, shard + 1
    if docs:
        yield done()


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, shard_ids: int = 1 << 20) -> None:
    """Write the ids of all documents, in ascending doc_id order, as a table of shards at ``path``."""
    tokenizer = tokenizer or default_path()
    parts = C.shuffle_parts(docs.sparkSession)
    df = C.clean(docs, "doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    df.mapInArrow(lambda it: _encode(it, tokenizer, end_id, shard_ids), SHARDS).write.parquet(path)


@C.tidy
def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            shard = Shard(r.payload)
            ids, ends = shard.all(), np.cumsum(shard.counts[:, 0])
            starts = ends - shard.counts[:, 0]
            crc = [C.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "start": starts + r.before, "n_tokens": shard.counts[:, 0], "ids_crc32": crc})


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of each document of a written table.

    A shard knows how many ids its part holds before it; the parts' own sums are one row
    for each task that wrote, whatever they hold.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("parts_before"))
    placed = shards.join(parts, "part").withColumn("before", F.col("parts_before") + F.col("earlier")).select("doc_ids", "payload", "before")
    return placed.mapInPandas(_decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_repair(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the ids of all documents, from the written shards."""
    import uuid

    path = f"{C.shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    write(C.table(spark, sf_dir, "documents"), path)
    return read(spark, path)


#: Subword tokenization has no SQL form; an exact round trip stands in.
SQL = None
