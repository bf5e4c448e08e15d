"""Helpers the training-data operators share: table reading, scratch tables, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.  Where it is unset and everything runs
    in this process (tests), a temporary one; on a cluster it has to be set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cortexloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when this program ends."""
    path = f"{shared_dir(spark)}/cortexloom-{kind}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((spark, path))
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


def _remove_scratch() -> None:
    for spark, path in _SCRATCH:
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return  # nothing is left that could remove them
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it again."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns can have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mapped(frame: DataFrame, run, schema: str) -> DataFrame:
    """frame.mapInArrow that gives memory back at the end of each task."""
    return frame.mapInArrow(lambda batches: released(run(batches)), schema)


def crc_mod(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts joined, and the n+1 offsets of the texts in them; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int):
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MUL1, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: The bits of a lane of eight bytes that its first k bytes take.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word above which it is hashed by itself.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiply, shift, multiply, shift."""
    x = (x ^ (x >> np.uint64(30))) * _MUL2
    x = (x ^ (x >> np.uint64(27))) * _MUL1
    return x ^ (x >> np.uint64(31))


def released(batches):
    """The batches of a task; when they are all given out, what the allocators hold goes back to the system,
    as Python workers live on and share an executor's memory."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of joined texts, and per text the index of its first word (n+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    new, last = solid.copy(), solid.copy()
    new[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    new[cut] |= solid[cut]
    last[cut - 1] |= solid[cut - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same at any place: lanes of eight bytes mixed in one by one, longer words by BLAKE2."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _MUL1 + _SEED)
    at, left, open_ = starts, np.where(sizes > LONG_WORD, 8, sizes), np.arange(len(starts))
    while len(open_):
        out[open_] = mix(out[open_] ^ (lanes[at] & _LANE[np.minimum(left, 8)]))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the run of `size` hashes from each place on, put together from runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    join = lambda a, b: mix(a * _MUL2 + b)
    power, length, out, done = hashes, 1, None, 0
    while True:
        if size & length:
            here = power[done : done + n]
            out = here if out is None else join(out, here)
            done += length
        if 2 * length > size:
            return mix(out ^ _SEED)
        power, length = join(power[:-length], power[length:]), 2 * length


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index at which each window of `size` words of one text starts, and a 64-bit hash of its word sequence."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(inside, np.maximum(first[1:] - size + 1, first[:-1]), 1)
    np.add.at(inside, first[1:], -1)
    at = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    return at, run_hashes(hashes, size)[at]
