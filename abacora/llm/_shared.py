"""Shared plumbing of the llm operators: scratch tables on shared storage and vectorised word hashing.

Words are maximal runs of bytes other than ASCII white space. Texts are handled as the UTF-8
buffers Arrow delivers, so a batch costs a handful of numpy passes instead of a Python loop over
words. Per-byte temporaries are built block by block and never for a whole batch.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SEPARATORS = bytes([9, 10, 11, 12, 13, 32])
#: Texts are handed on in chunks of about this many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is configured and all runs on one machine (tests)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="abacora-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder below the shared one."""
    path = f"{scratch_root(spark).rstrip('/')}/abacora-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, keep: list[DataFrame]):
    """Deletes at its end what was written to scratch paths inside, but for the tables put into keep."""
    _scopes.append([])
    try:
        yield
    finally:
        kept = {df.scratch for df in keep}
        for path in _scopes.pop():
            if path not in kept:
                remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has left in the shared folder; for when its results have been read or written elsewhere."""
    remove(spark, f"{scratch_root(spark).rstrip('/')}/abacora-{spark.sparkContext.applicationId}")


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While open, shuffle files of each finished action are removed at once; the setting is restored."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what materialize() wrote; the tables must not be read any more."""
    for df in tables:
        if df is not None:
            remove(df.sparkSession, df.scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever storage it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hands memory that this process has freed, but still holds, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run(), after which the task's worker, which waits for other tasks beside the executor's own work, holds no more than it needs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about `most` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WBASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WBASE_INV = np.uint64(pow(int(_WBASE), -1, 1 << 64))
_power_cache: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _power_cache.get(int(base))
    if have is None or len(have) < n:
        made = np.full(max(n, _BLOCK), base, np.uint64)
        made[0] = 1
        np.multiply.accumulate(made, out=made)
        if len(made) > 4 * _BLOCK:
            return made
        _power_cache[int(base)] = have = made
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scan_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order. A word never crosses a row's edge."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    sep = _SEP[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:] = True
    edge[1:-1] = sep[:-1]
    edge[0] = True
    edge[offsets] = True
    starts = np.flatnonzero(~sep & edge[:-1])
    edge[:-1] = sep
    edge[-1] = True
    edge[offsets] = True
    ends = np.flatnonzero(~sep & edge[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; with lower, A-Z count as a-z."""
    table, out, i, n = _BYTE_LOWER if lower else _BYTE, np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + _BLOCK)))
        if j > i + 1 and ends[j - 1] - a > 2 * _BLOCK:
            j -= 1
        b = ends[j - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * _powers(_BASE, b - a)[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _powers(_BASE_INV, b - a)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of words[i : i + k] for every i; rows are not looked at."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    keyed = mix(words + np.uint64(salt)) if salt else words
    np.cumsum(keyed * _powers(_WBASE, len(words))[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_WBASE_INV, len(words))[:n] + np.uint64(k))


def id_array(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False))
