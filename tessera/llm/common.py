"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the C library where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Text handled at a time inside a Python task, so that memory follows this and not the partition.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    for _ in range(3):  # what Python lets go of reaches the JVM a moment later, and files go a moment after that
        gc.collect()
        time.sleep(0.7)
        spark._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def give_back() -> None:
    """Return freed memory to the system, which allocators keep otherwise: workers live on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `limit` bytes of the column each; a longer value is a slice of its own."""
    if batch.num_rows == 0:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cells = np.cumsum(size) // limit
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    _mix64(x, np.empty_like(x))
    return x


def _mix64(x: np.ndarray, free: np.ndarray) -> None:
    """mix64 in place; `free` is overwritten."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(x, np.uint64(shift), out=free)
            np.bitwise_xor(x, free, out=x)
            if factor:
                np.multiply(x, np.uint64(factor), out=x)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number, zeros beyond the end."""
    n = (len(data) + 7) // 8 * 8
    padded = np.concatenate([data, np.zeros(n - len(data) + 8, np.uint8)])
    out = np.empty(n, np.uint64)
    for r in range(8):
        out[r::8] = padded[r : r + n].copy().view("<u8")
    return out[: len(data)]


#: Longer strings are hashed one by one.
SHORT = 512


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task; eight bytes of all strings at a time."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return hash_runs(raw, offsets[:-1] - offsets[0], np.diff(offsets))


#: Runs hashed at a time, so that their arrays stay in the processor's cache.
RUNS = 1 << 14
#: Of a run by its size: what the hash starts from, and which bits of its last eight bytes count (by the size modulo 8).
_SEED = mix64(np.arange(SHORT + 1).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_LAST = ~np.uint64(0) >> np.array([0, 56, 48, 40, 32, 24, 16, 8], np.uint64)


def hash_runs(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    h = np.empty(len(size), np.uint64)
    free = np.empty(min(RUNS, len(size)), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(size), RUNS):
            at, n, own = start[a : a + RUNS], size[a : a + RUNS], h[a : a + RUNS]
            np.take(_SEED, n, out=own, mode="clip")
            live, k = None, 0  # all at first; then those that have more than k bytes
            if n.min() == 0 or n.max() > SHORT:
                live = np.flatnonzero((n > 0) & (n <= SHORT))
                at, n, own = at[live], n[live], own[live]
            while len(n):
                w = words[at + k if k else at]
                last = n <= k + 8
                np.bitwise_and(w, np.where(last, _LAST[n & 7], ~np.uint64(0)), out=w)
                np.multiply(own, np.uint64(0xC2B2AE3D27D4EB4F), out=own)
                np.add(own, w, out=own)
                _mix64(own, free[: len(own)])
                if live is not None:
                    h[a + live] = own
                k += 8
                more = np.flatnonzero(~last)
                live = more if live is None else live[more]
                at, n, own = at[more], n[more], own[more]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
    return h


def _white() -> tuple[bytes, dict[int, np.ndarray]]:
    """White space as UTF-8: which single bytes are (1, else 0), and the sequences of more bytes by their first one."""
    points = pa.array([chr(c) for c in range(1, 0x3100)], pa.string())
    found = [c.encode() for c in points.filter(pc.utf8_is_space(points)).to_pylist()]
    one = bytes(bytes([c]) in found for c in range(256))
    more = sorted(c for c in found if len(c) > 1)
    return one, {first: np.array([list(c[1:]) for c in more if c[0] == first], np.uint8) for first in {c[0] for c in more}}


_ONE, _MORE = _white()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the hash of each lower-case word of each text; words are runs without white space."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    _, offsets, data = low.buffers()
    offsets = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = np.frombuffer(bytearray(raw.tobytes().translate(_ONE)), bool)
    for first, rests in _MORE.items():
        at = np.flatnonzero(raw == first)
        width = rests.shape[1]
        at = at[at + width < len(raw)]
        for rest in rests if len(at) else ():
            hit = at[np.all([raw[at + 1 + k] == rest[k] for k in range(width)], axis=0)]
            for k in range(width + 1):
                white[hit + k] = True
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    word = ~white
    before = word & edge[:-1]
    before[1:] |= word[1:] & white[:-1]
    after = word & edge[1:]
    after[:-1] |= word[:-1] & white[1:]
    start = np.flatnonzero(before)
    return hash_runs(raw, start, np.flatnonzero(after) + 1 - start), np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct word shingles, ascending.

    A text of fewer words than `width`, but at least one, has one shingle of all its words; one without words has none.
    """
    words, offsets = word_hashes(texts)
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for k in range(width):
            shifted = np.zeros(len(words), np.uint64)
            shifted[: len(words) - k if k else None] = words[k:]
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(k + 1))
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words)) - offsets[:-1][row]
        whole = place <= n[row] - width
        hashes, rows = rolled[whole], row[whole]
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for i, r in enumerate(short):
                h = np.uint64(n[r])
                for w in words[offsets[r] : offsets[r + 1]]:
                    h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w], np.uint64))[0]
                own[i] = h
            hashes, rows = np.concatenate([hashes, own]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[first], rows[first]
    return hashes, np.searchsorted(rows, np.arange(len(n) + 1))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
