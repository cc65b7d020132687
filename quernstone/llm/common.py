"""Shared helpers: scratch tables on the shared folder and flat views of text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_recorders: list[list[str]] = []
_at_exit: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_root[app] = tempfile.mkdtemp(prefix="quernstone-")
    return _own_root[app]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder below the shared one; that folder goes when the driver's process ends."""
    own = f"{shared_root(spark)}/quernstone/{spark.sparkContext.applicationId}"
    if own not in _at_exit:
        _at_exit.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, own: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the application has ended before its process
        _delete(spark, [own])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _recorders:
        _recorders[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """While it lasts, paths of tables that ``materialise`` writes are added to ``paths``."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded tables; results that read them must have been written."""
    _delete(spark, paths)
    paths.clear()


def narrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: fewer rows than the default, so that long texts do not fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offs.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_WORD_T = byte_table(20240)
_WORD_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of word bytes; runs end with their row."""
    n = int(offsets[-1] - offsets[0])
    base = int(offsets[0])
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data[base : base + n]]
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1] - base
    edges = edges[edges < n]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    # a run ends before the next non-word byte or the next run's start
    ends_flag = ~inside[1 : n + 1]
    ends_flag[:-1] |= begin[1:]
    ends = np.flatnonzero(ends_flag & inside[:n]) + 1
    rows = np.searchsorted(offsets[1:] - base, starts, "right")
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, _WORD_P, np.uint64)) if longest else np.zeros(0, np.uint64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    value = _WORD_T[_LOWER[data[at]]] * powers[place]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


#: Word bytes: anything but white space; and letters, digits and all non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
