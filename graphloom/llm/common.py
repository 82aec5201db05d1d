"""Helpers that several operators share: Arrow text buffers, hashes, row numbers.

Everything here is a small building block for code that runs inside Spark tasks;
the partitioning and the shuffles are always Spark's.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import discard, shared_dir, stored  # noqa: F401

U64 = np.uint64
#: An odd multiplier for polynomial hashes modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)


def tidy(generator: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator that at its end hands freed memory back to the system.

    Python workers live on from task to task; what they keep of an earlier stage's
    arrays would stand beside what the next stage needs.
    """

    @functools.wraps(generator)
    def run(*args, **how):
        try:
            yield from generator(*args, **how)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def windows_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours, by doubling; k passes become log2(k)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    part, size, acc, done, bits = values.astype(U64), 1, None, 0, k
    while bits:
        if bits & 1:
            # acc covers the first ``done`` values of each window, part the next ``size``
            acc = part if acc is None else acc[: len(part) - done] * power(size) + part[done:]
            done += size
        bits >>= 1
        if bits:
            part = part[:-size] * power(size) + part[size:]
            size *= 2
    return acc[:n]


def power(k: int) -> np.uint64:
    return U64(pow(int(BASE), k, 1 << 64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return raw, (at - at[0]) if len(at) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most`` text bytes (one row at least).

    The text is the column ``text``, or the one in ``row`` where rows pass through whole.
    """
    raw, at = text_buffer(batch["text"] if "text" in batch.schema.names else batch["row"].field("text"))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table: True for bytes in any of the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def words_of(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of class ``inside``, and the word offsets of each row.

    Words never cross rows.
    """
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    is_in = inside[raw]
    cut = np.zeros(len(raw), bool)
    first = at[:-1]
    cut[first[first < len(raw)]] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = is_in[:-1]
    start = np.flatnonzero(is_in & (~before | cut))
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = ~is_in[1:] | cut[1:]
    end = np.flatnonzero(is_in & after) + 1
    return start, end, np.searchsorted(start, at)


def words_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums; equal words get equal hashes.

    Words are taken in runs of about a quarter megabyte, so that the sums stay small
    whatever is passed in; one longer word is a run of its own.
    """
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 18), "right")))
        first, last = int(start[at]), int(end[to - 1])
        up, back = _powers(last - first)
        sums = np.zeros(last - first + 1, U64)
        np.cumsum((raw[first:last].astype(U64) + U64(1)) * up, out=sums[1:])
        s, e = start[at:to] - first, end[at:to] - first
        out[at:to] = mix((sums[e] - sums[s]) * back[s])
        at = to
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; up to a quarter million are kept."""
    def make(n: int) -> list[np.ndarray]:
        back = np.ones(n, U64)
        back[1:] = U64(pow(int(BASE), -1, 1 << 64))
        return [powers(n), np.multiply.accumulate(back)]

    if n > 1 << 18:
        return tuple(make(n))
    if not _POWERS:
        _POWERS.extend(make(1 << 18))
    return _POWERS[0][:n], _POWERS[1][:n]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def clean(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only picks rows and columns of files that it reads once each."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    files = list(plan.relation().location().inputFiles())
    return len(files) == len(set(files)) and sum(map(len, files)) <= FILE_NAMES


#: Bytes of file names up to which files are numbered by a broadcast table.
FILE_NAMES = 32 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """rid (a number of the row), row (all its columns) and text; doc_id need not be unique.

    Rows of files are numbered by their file and their place in it, whatever splits
    a job reads them in: Spark sizes splits by the cores there are at the time, so numbers that
    count rows by partition would change from job to job.  All other rows are stored with their numbers.
    """
    if _is_scan(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            rows = docs.select(meta["file_path"].alias("__file"), meta["row_index"].alias("__at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
        except AnalysisException:  # a format whose rows have no place
            pass
        else:
            names = sorted(r[0] for r in rows.select("__file").distinct().collect())
            if len(names) < 2:
                return rows.select(F.col("__at").cast("bigint").alias("rid"), "row", "text")
            files = docs.sparkSession.createDataFrame(list(enumerate(names)), "__k bigint, __file string")
            return rows.join(F.broadcast(files), "__file").select((F.shiftleft("__k", 36) + F.col("__at")).alias("rid"), "row", "text")
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"), F.col("text").alias("text")), "numbered")
