"""Helpers that the corpus operators share: tables, settled intermediate results, Arrow text blocks, hashing."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
#: Bytes of a batch that goes to a Python worker, where the session sets none; a longer row is a batch of its own.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set and all executors are this process (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: the lineage ends there, and lost executors lose nothing.

    The tables of an application stand in one folder, which can go when it has ended (results are read from it until then).
    """
    path = f"{shared_dir(df.sparkSession)}/sparkloom-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # glibc's only


def give_back() -> None:
    """Returns what this process has freed to the system: workers live on between tasks, and would keep their greatest size."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of bounded bytes, not only rows, and workers that give their memory back after a task."""
    if not df.sparkSession.conf.get(BATCH_BYTES, None):
        df.sparkSession.conf.set(BATCH_BYTES, str(BATCH))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that df's columns don't have, whatever their case: those given, with underscores before them where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def joined_skewed(rows: DataFrame, by_key: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows inner-joined with by_key (a row for each key, of which `weight` says how many of rows have it), so that no key is a task's load.

    Keys of more than a tenth of a partition's even share of rows are broadcast: at most ten for each partition. The others are merged.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = by_key.agg(F.sum(weight)).first()[0] or 0
    most = max(1, total // (10 * parts))
    hot = F.broadcast(by_key.where(F.col(weight) > most))
    cold = rows.join(F.broadcast(by_key.where(F.col(weight) > most).select(*on)), on, "left_anti").hint("merge").join(by_key.where(F.col(weight) <= most), on)
    return rows.join(hot, on).union(cold)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> S33)
    x = x * MIX_A
    x = x ^ (x >> S33)
    x = x * MIX_B
    return x ^ (x >> S33)


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about `most` bytes; a longer row makes a block of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_BYTES = byte_table(29)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks of bytes that make words: all but ASCII blanks; and letters, digits and bytes over 127 only.
UNBLANK = np.ones(256, bool)
UNBLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block of rows, A-Z lower-cased, and where each row's words begin (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = mask[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = word[rows]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.arange(len(data)) - begin[np.maximum(np.cumsum(first) - 1, 0)]
    at[~word] = 0
    up = np.full(int(at.max()) + 1, _BASE)
    up[0] = 1
    value = _BYTES[np.where((data >= 65) & (data <= 90), data + 32, data)] * np.cumprod(up, dtype=np.uint64)[at]
    value[~word] = 0
    return mix64(np.add.reduceat(value, begin)), np.searchsorted(begin, offsets, side="left")


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that begin at each word (fewer at the end: the array is n - 1 shorter)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : k + size]
    return mix64(out)
