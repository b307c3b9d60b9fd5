"""Shared helpers: tables, scratch storage in the cluster's shared folder, and
numpy views of Arrow text columns (no Python string per word).

Text work runs in ``mapInArrow``.  A batch is cut into slices of a few MB so a
worker's memory does not depend on the batch size; a single text is never cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: bytes of text handled at once by the numpy kernels of one task
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).  Only a local
    session without the setting (tests) gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder all executors share")
        path = tempfile.mkdtemp(prefix="ebbflow-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the
    lineage is cut and losing executors does not lose it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_remainder(col: str, modulus: int, value: int):
    """crc32(column as text) mod ``modulus`` == ``value``; a null column is not in the fold."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus == value, F.lit(False))


# ------------------------------------------------------------------ Arrow text
def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most ``limit`` bytes (or one row)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) for each slice of the batch's text column."""
    data, off = text_buffers(batch.column(column))
    for i, j in slices(off, limit):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]


# ---------------------------------------------------------------- words, hashes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the words ``[^\\x20\\x09-\\x0D]+``."""
    ink = ~_SPACE[data]
    prev = np.empty_like(ink)
    prev[1:] = ink[:-1]
    nxt = np.empty_like(ink)
    nxt[:-1] = ink[1:]
    if len(data):
        full = off[:-1][off[1:] > off[:-1]]
        prev[full] = False
        nxt[off[1:][off[1:] > off[:-1]] - 1] = False
    starts = np.flatnonzero(ink & ~prev)
    ends = np.flatnonzero(ink & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, off)


def _splitmix_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = np.array(x, U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW


class SpanHash:
    """64-bit hashes of any byte spans of one buffer from a prefix sum (equal bytes,
    equal hash, wherever the span stands)."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        pw, _ = _powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(_splitmix_constants(256, seed)[data] * pw[:n], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inv = _powers(len(self.prefix))[1]
        return mix64((self.prefix[ends] - self.prefix[starts]) * inv[starts] + (ends - starts).astype(U64))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (length len(h) - n + 1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k:k + m]
    return mix64(out)


def group_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range off[i]:off[i+1] (empty ranges give 0)."""
    c = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def owners(off: np.ndarray) -> np.ndarray:
    """Index of the range each element belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sorted_groups(batches, key: str) -> Iterator[pa.RecordBatch]:
    """Groups of a partition that is sorted by ``key`` (never null), a record batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        new = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1))
        cuts = np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column(key)[-1] != k[0]:
            yield _joined(held)
            held = []
        at = 0
        for c in cuts:
            held.append(batch.slice(at, int(c) - at))
            yield _joined(held)
            held, at = [], int(c)
        held.append(batch.slice(at))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
