"""Exact substring dedup with a sparse, range-partitioned suffix array.

A byte goes if some 400-byte string that covers it also starts anywhere else.
Every 400-byte window is represented by one suffix: the one that begins at the
window's minimizer, the least hash of ``lead`` neighbouring bytes.  Equal windows
have their minimizer at the same place, so two windows are equal only if their
suffixes share their leading bytes and the text before them agrees as well.

1. Each task finds the minimizers of its documents.  A minimizer stands for a run
   of window starts; its context is the text that those windows cover.
2. Equal contexts are counted by digest.  A context seen twice is a repeat as a
   whole, which settles copies without sorting them; a leading hash that occurs
   in one context only is unique.  Only one sample of each context goes on.
3. The remaining suffixes are range-partitioned by sampled splitters on all their
   bytes (ties by digest, so that equal suffixes can fill several buckets), so
   that buckets are ranges of the sorted suffixes.  Buckets sort locally by
   multikey quicksort; neighbours with equal leading bytes form groups, in which
   windows are compared.
4. Groups at a bucket's edge may go on in the next bucket: what several buckets
   have is compared across the boundaries, one window for each bucket and string,
   as far as the texts before the suffixes agree with any other.
5. Repeated runs are gathered for each document and cut out of its text.

Defined cases: null texts count as empty; texts under 400 bytes lose nothing;
repeated rows are copies of each other; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, LEAD = 400, 64
#: Bytes that a task hashes at once; positions inside must fit into 20 bits.
SLICE = (1 << 20) - 2048
ANCHORS = "rid bigint, a bigint, dlo int, dhi int, core bigint, c1 bigint, c2 bigint"
CONTEXTS = "core bigint, c1 bigint, c2 bigint, dlo int, dhi int, rid bigint, a bigint, before binary, suffix binary"
BUCKETS = "core bigint, c1 bigint, c2 bigint, dlo int, dhi int, rid bigint, a bigint, ranges array<struct<s:bigint,e:bigint>>, bucket int, windows array<struct<d:bigint,h:bigint,hit:boolean>>, probes array<bigint>"
#: Bytes that are no white space, and the bytes that stand for a word where passages are counted in words.
WORD, SYMBOL = ~C.byte_class([(9, 13), (32, 32)]), 8
#: Words of a repeated passage: over 50.
PASSAGE = 51
#: Bytes, and words of a passage, from one place before a suffix to the next at which groups over several buckets are compared.
PROBE, PROBE_WORDS = 24, 12
BYTES = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def minimizers(raw: np.ndarray, at: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and last window start, leading hash) of each minimizer; windows stay inside rows."""
    w = length - lead + 1
    if len(raw) < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    full = C.windows_hash(raw, lead)
    # the low 20 bits hold the place: of equal hashes the leftmost wins
    least = (C.mix(full) & ~C.U64((1 << 20) - 1)) | np.arange(len(full), dtype=np.uint64)
    size, part = 1, least
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    if size < w:
        part = np.minimum(part[: len(full) - w + 1], part[w - size :][: len(full) - w + 1])
    valid = np.zeros(len(part) + 1, np.int32)
    first, last = at[:-1], at[1:] - length  # windows of a row start in first..last
    ok = last >= first
    np.add.at(valid, first[ok], 1)
    np.add.at(valid, last[ok] + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    place = (part[starts] & C.U64((1 << 20) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place)) - 1
    return place[begin], starts[begin], starts[end], full[place[begin]]


def _slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, offset in the row, bytes, offsets) of runs of rows; a longer row comes in overlapping slices."""
    row = 0
    for part, raw, at in C.pieces(batch, SLICE):
        n = part.num_rows
        if len(raw) <= SLICE:
            yield np.arange(row, row + n), np.zeros(n, np.int64), raw, at
        else:
            for s in range(0, len(raw) - length + 1, SLICE):
                cut = raw[s : s + SLICE + length - 1]
                yield np.array([row]), np.array([s]), cut, np.array([0, len(cut)])
        row += n


@C.tidy
def _anchors(batches: Iterator[pa.RecordBatch], length: int, lead: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch["rid"].to_numpy()
        for rows, offset, raw, at in _slices(batch, length):
            place, lo, hi, core = minimizers(raw, at, length, lead)
            if not len(place):
                continue
            row = np.searchsorted(at, place, "right") - 1
            data = raw.tobytes()
            digests = b"".join([hashlib.blake2b(data[i : j + length], digest_size=16).digest() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
            digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
            cols = [rid[rows[row]], place - at[row] + offset[row], (place - lo).astype(np.int32), (place - hi).astype(np.int32), core.view(np.int64), digests[:, 0], digests[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "a", "dlo", "dhi", "core", "c1", "c2"])


@C.tidy
def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cut the contexts of the samples out of their texts."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for rid, packed, want in zip(batch["rid"].to_pylist(), batch["packed"], batch["want"].to_pylist(), strict=True):
            text = open_.decompress(packed.as_py())
            for x in want:
                a, lo, hi = x["a"], x["a"] - x["dlo"], x["a"] - x["dhi"]
                out.append((x["core"], x["c1"], x["c2"], x["dlo"], x["dhi"], rid, a, text[lo:a], text[a : hi + length]))
            if len(out) > 5000:
                yield _batch(out, CONTEXTS)
                out = []
        if out:
            yield _batch(out, CONTEXTS)


_ARROW = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<struct<d:bigint,h:bigint,hit:boolean>>": pa.list_(pa.struct([("d", pa.int64()), ("h", pa.int64()), ("hit", pa.bool_())])), "array<struct<s:bigint,e:bigint>>": pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of byte strings, given as rows of big-endian 8-byte words, by multikey quicksort.

    All segments advance together: each is parted into less, equal and greater
    around its own pivot word, and the equal part moves on to the next word.
    """
    n, width = keys.shape
    order = np.arange(n)
    seg = np.zeros(n, np.int64)  # first place of each element's segment
    depth = np.zeros(n, np.int64)
    live = np.arange(n) if n > 1 else np.empty(0, np.int64)
    while len(live):
        s = seg[live]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(first, len(live)))
        word = keys[order[live], depth[live]]
        three = np.sort(np.stack([word[first], word[first + size // 2], word[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (word > pivot).astype(np.int8) - (word < pivot).astype(np.int8)
        run = np.repeat(np.arange(len(first)), size)
        to = np.argsort(run * 3 + side + 1, kind="stable")
        order[live], side, run = order[live][to], side[to], run[to]
        deeper = depth[live] + (side == 0)
        code = run * 3 + side
        new = np.append(True, code[1:] != code[:-1])
        seg[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        depth[live] = deeper
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        live = live[(count > 1) & (deeper < width)]
    return order


def _words(strings: list[bytes], length: int) -> np.ndarray:
    width = math.ceil(length / 8)
    return np.frombuffer(b"".join(x.ljust(width * 8, b"\0") for x in strings), ">u8").reshape(-1, width).astype(np.uint64)


@C.tidy
def _bucket(batches: Iterator[pa.RecordBatch], length: int, lead: int, step_: int, probe: int) -> Iterator[pa.RecordBatch]:
    """Sort one bucket's suffixes; compare the windows of suffixes that share their leading bytes.

    Other buckets are told of windows that start at a multiple of ``step_``.
    """
    parts, bucket = list(batches), TaskContext.get().partitionId()
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    head = [rows[c].to_pylist() for c in ("core", "c1", "c2", "dlo", "dhi", "rid", "a")]
    before, suffix = rows["before"].to_pylist(), rows["suffix"].to_pylist()
    keys = _words(suffix, length)
    order = multikey_order(keys)
    # A window that starts d bytes before its suffix needs 400 - d equal bytes; no suffix shares
    # more with one than its neighbours do, as buckets are ranges of whole suffixes.  Beyond the
    # bucket's ends the neighbour is unknown.
    differ = keys[order][1:] != keys[order][:-1]
    common = np.where(differ.any(axis=1), np.argmax(differ, axis=1) * 8 + 7, length)
    most = np.maximum(np.append(length, common), np.append(common, length))
    del keys, differ
    least_d = np.empty(len(order), np.int64)
    least_d[order] = np.maximum(np.array(head[4])[order], length - most)
    leading = _words([suffix[i][:lead] for i in order], lead)
    group = np.cumsum(np.append(True, (leading[1:] != leading[:-1]).any(axis=1))) - 1
    size = np.bincount(group)
    bounds = np.append(0, np.cumsum(size))
    at = 0
    while at < len(size):  # runs of groups with about a million windows
        end = at
        windows = 0
        while end < len(size) and (end == at or windows < 1_000_000):
            windows += sum(max(0, head[3][i] - least_d[i] + 1) for i in order[bounds[end] : bounds[end + 1]])
            end += 1
        own = order[bounds[at] : bounds[end]]
        of = group[bounds[at] : bounds[end]]
        at = end
        strings = [before[i] + suffix[i] for i in own]
        hashes = C.windows_hash(np.frombuffer(b"".join(strings), np.uint8), length)
        start = np.cumsum([0, *map(len, strings)])
        dlo, n = np.array([head[3][i] for i in own]), np.array([max(0, head[3][i] - least_d[i] + 1) for i in own])
        member = np.repeat(np.arange(len(own)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = C.mix(hashes[start[member] + step])
        d = dlo[member] - step
        key = C.mix(h ^ C.mix((of[member].astype(np.uint64) << C.U64(20)) | d.astype(np.uint64)))
        sort = np.argsort(key, kind="stable")
        twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
        same = key[sort][1:] == key[sort][:-1]
        twice[sort[1:][same]] = again[sort[1:][same]] = True
        twice[sort[:-1][same]] = True
        edge = (of == 0) | (of == len(size) - 1)
        out = []
        ends = np.cumsum(n)
        for k, i in enumerate(own):
            own_windows = slice(ends[k] - n[k], ends[k])
            hit = twice[own_windows]
            # of equal windows, one tells the other buckets
            tell = [{"d": x, "h": y, "hit": z} for x, y, z, w in zip(d[own_windows].tolist(), h[own_windows].view(np.int64).tolist(), hit.tolist(), again[own_windows].tolist(), strict=True) if not w and (head[6][i] - x) % step_ == 0] if edge[k] else None
            if tell or hit.any():
                probes = [int.from_bytes(hashlib.blake2b(before[i][-p:], digest_size=8).digest(), "little", signed=True) for p in range(probe, head[3][i] + 1, probe)] if tell else None
                out.append((*[c[i] for c in head], runs(hit), bucket, tell, probes))
        if out:
            yield _batch(out, BUCKETS)


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    """First and last index of each run of True."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"s": s, "e": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist(), strict=True)]


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text as 8 bytes: 6 of its hash, 2 of the white space behind it."""
    for batch in batches:
        out = []
        for text in batch["text"]:
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            start, end, _ = C.words_of(raw, np.array([0, len(raw)]), WORD)
            codes = C.words_hash(raw, start, end) & ~C.U64(0xFFFF)
            if len(start) > 1:
                gap, size = raw[end[:-1]].astype(C.U64), start[1:] - end[:-1]
                wide = size > 1  # one byte stands for itself, all else for its hash
                gap[wide] = C.U64(256) + C.words_hash(raw, end[:-1][wide], start[1:][wide]) % C.U64(65280)
                codes[:-1] |= gap
            out.append(codes.astype(">u8").tobytes())
        yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(out, pa.binary())], names=["rid", "text"])


def repeated_passages(docs: DataFrame, words: int, lead: int = LEAD) -> DataFrame:
    """rid and the runs (s, e) of whole words that repeated passages of ``words`` words cover.

    A passage is a string of 8 * words - 2 bytes of the codes that begins with a word;
    the white space behind its last word does not count.
    """
    length = SYMBOL * words - 2
    first, last = F.ceil(F.col("s") / SYMBOL).cast("bigint"), F.floor((F.col("e") - length) / SYMBOL).cast("bigint")
    return repeated_spans(docs, length, lead, SYMBOL, _word_codes).select("rid", first.alias("s"), (last + words).alias("e")).where(F.col("e") - F.col("s") >= words)


@C.tidy
def _cut(batches: Iterator[pa.RecordBatch], keep: bool, whole: bool, words: bool, schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Take the repeated runs out of each text."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        cols: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for packed, spans in zip(batch["packed"], batch["spans"].to_pylist(), strict=True):
            text = open_.decompress(packed.as_py())
            out: list[list[int]] = []
            if words and spans:
                start, end, _ = C.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORD)
                spans = [{"s": int(start[x["s"]]), "e": int(end[x["e"] - 1])} for x in spans]
            for s, e in sorted((x["s"], x["e"]) for x in spans or []):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            for run in out if whole else ():  # a character that is covered in part stays
                while run[0] < run[1] and text[run[0]] & 0xC0 == 0x80:
                    run[0] += 1
                while run[0] < run[1] < len(text) and text[run[1]] & 0xC0 == 0x80:
                    run[1] -= 1
            ends = [0, *(e for _, e in out)]
            left = b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in out), len(text)], strict=True))
            cols["n_bytes"].append(len(text))
            cols["n_removed"].append(len(text) - len(left))
            cols["n_spans"].append(len(out))
            cols["kept"].append(left if keep else hashlib.sha256(left).digest())
        new = {k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in cols.items()}
        yield pa.RecordBatch.from_arrays([new.get(n, batch[n] if n in batch.schema.names else None) for n in schema], names=schema)


def _as_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches


def _packed(docs: DataFrame, code: Callable = _as_is) -> DataFrame:
    """rid and the text as a Zstandard frame: what is shuffled is a third of the text.  code: what becomes of a batch first."""

    @C.tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in code(batches):
            texts = batch["text"].cast(pa.binary())
            packed = [press.compress(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(packed, pa.binary())], names=["rid", "packed"])

    return docs.mapInArrow(squeeze, "rid bigint, packed binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, step: int = 1, code: Callable = _as_is) -> DataFrame:
    """rid and the byte runs (s, e) that repeated strings cover.  docs: rid (unique), text.

    step: only strings that start at its multiples need be found.  code: what turns
    batches of texts into those of the bytes that are looked at.
    """
    spark, probe = docs.sparkSession, PROBE if step == 1 else PROBE_WORDS * step
    parts = C.shuffle_parts(spark)
    anchors = C.stored(docs.mapInArrow(lambda it: _anchors(code(it), length, lead), ANCHORS), "anchors")
    key = ["core", "c1", "c2", "dlo", "dhi"]
    contexts = C.stored(anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min_by("a", "rid").alias("a")), "contexts")
    # leading bytes in several contexts, at least one of them undecided
    shared = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("core")
    undecided = contexts.join(shared, "core")
    want = undecided.groupBy("rid").agg(F.collect_list(F.struct(*key, "a")).alias("want"))
    texts = C.stored(_packed(docs, code).join(want, "rid").mapInArrow(lambda it: _contexts(it, length), CONTEXTS), "suffixes")
    buckets = max(parts, texts.count() // 12_000 + 1)
    sorted_ = texts.repartitionByRange(buckets, "suffix", "c1")
    compared = C.stored(sorted_.mapInArrow(lambda it: _bucket(it, length, lead, step, probe), BUCKETS), "buckets")
    ids = ["core", "c1", "c2", "dlo", "dhi", "rid", "a"]
    within = compared.select(*ids, F.explode("ranges").alias("r")).select("rid", (F.col("a") - F.col("dlo") + F.col("r.s")).alias("s"), (F.col("a") - F.col("dlo") + F.col("r.e") + length).alias("e"))
    # leading bytes that several buckets have; their windows meet once for each bucket
    over = compared.where(F.col("windows").isNotNull()).groupBy("core").agg(F.min("bucket").alias("b0"), F.max("bucket").alias("b1")).where("b0 < b1").select("core")
    edge = edge0 = C.stored(compared.where(F.col("windows").isNotNull()).join(over, "core").drop("ranges", "bucket"), "edges")
    # how far the text before a suffix agrees with that of any other bounds its windows from the left
    probes = edge.select(*ids, F.posexplode("probes").alias("i", "p"))
    agree = probes.groupBy("core", "i", "p").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core", "i", "p")
    reach = probes.join(agree, ["core", "i", "p"]).groupBy(*key).agg(F.max("i").alias("i"))
    bound = probe * (F.coalesce("i", F.lit(-1)) + 2) - 1
    edge = edge.join(reach, key, "left").select(*ids, F.explode(F.filter("windows", lambda w: w["d"] <= bound)).alias("w")).select(*ids, "w.d", "w.h", "w.hit")
    twice = edge.groupBy("core", "d", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core", "d", "h")
    across = edge.where("NOT hit").join(twice, ["core", "d", "h"]).select("rid", (F.col("a") - F.col("d")).alias("s"), (F.col("a") - F.col("d") + length).alias("e"))
    copies = anchors.join(contexts.where("n > 1").select(*key), key, "left_semi").select("rid", (F.col("a") - F.col("dlo")).alias("s"), (F.col("a") - F.col("dhi") + length).alias("e"))
    spans = C.stored(within.unionByName(across).unionByName(copies), "spans")
    C.discard(anchors, contexts, texts, compared, edge0)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, keep: bool = True, whole: bool = False, words: int = 0) -> DataFrame:
    """row (all columns but text), n_bytes, n_removed, n_spans, kept (remaining bytes, or their SHA-256 if not keep).

    whole: leave characters whole, so that the remaining bytes are UTF-8 again.
    words: if given, repeats are passages of so many whole words, whatever their bytes.
    """
    numbered = C.numbered(docs)
    slim = numbered.select("rid", "text")
    found = repeated_passages(slim, words, lead) if words else repeated_spans(slim, length, lead)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rest = docs.columns
    rows = numbered.select("rid", F.struct(*[F.col(f"row.`{c}`") for c in rest if c != "text"]).alias("row"))
    packed = _packed(slim).join(spans, "rid", "left")
    cut = packed.mapInArrow(lambda it: _cut(it, keep, whole, words > 0, ["rid", "n_bytes", "n_removed", "n_spans", "kept"]), f"rid bigint, {BYTES}")
    return rows.join(cut, "rid")


def dedup_documents(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, words: int = 0) -> DataFrame:
    """The documents with repeated strings cut out of their texts; null texts stay null, other columns stay."""
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").isNull().alias("__null"))
    out = remove_repeats(marked, length, lead, whole=True, words=words)
    text = F.when(~F.col("row.__null"), F.decode("kept", "UTF-8")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def passage_words(docs: DataFrame, words: int = PASSAGE, lead: int = LEAD) -> DataFrame:
    """rid and n_passage_words: how many words of a text stand in passages of ``words`` words or more that start anywhere else too.

    docs: rid (unique), text; texts without such passages give no row.
    """
    spans = repeated_passages(docs, words, lead).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    add = lambda x, r: F.struct((x["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], x["end"]))).alias("n"), F.greatest(x["end"], r["e"]).alias("end"))
    return spans.select("rid", F.aggregate("spans", start, add)["n"].alias("n_passage_words"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``remove_repeats`` over all documents, and the words that stand in repeated passages of over 50 words."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, keep=False)
    # a row of a file has the same number each time
    words = passage_words(C.numbered(docs).select("rid", "text"))
    out = out.join(words, "rid", "left")
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words"))


#: SQL has no substring index; brute force over all 400-byte strings stands in.
SQL = None
