"""What the operators share: scratch tables in the shared folder, and vectorised
word and byte-window hashing of Arrow string batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD_MULT = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes hashed at a time; bounds the temporary arrays (about 10 of 8 bytes each).
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own, for a local master only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillstream-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstream/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and rereads it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` returned, once nothing is to be computed from them any more."""
    for table in tables:
        if path := table.__dict__.pop("_scratch", None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which others are dropped by a broadcast of what names them; beyond, by a shuffle.
BROADCAST_ROWS = 400_000


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, u (a hash that tells texts of one doc_id apart) and ``row``, a struct of all columns of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("u"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


class _Tables:
    """Powers of the base, grown on demand and kept by the worker."""

    up = _powers(_BASE, CHUNK + 1)
    down = _powers(_BASE_INV, CHUNK + 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n < len(cls.up):
            return cls.up, cls.down
        return _powers(_BASE, n + 1), _powers(_BASE_INV, n + 1)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times base**i, modulo 2**64."""
    up, _ = _Tables.upto(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte window of data, by its first byte."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = prefix_hash(data)
    _, down = _Tables.upto(len(data))
    return mix((p[k : k + n] - p[:n]) * down[:n])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each maximal run without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (run without ASCII white space) of one text; A-Z lower-cased if asked."""
    if lower:
        data = _LOWER[data]
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not SPACE[data[end]]:  # never inside a word
            gap = np.flatnonzero(SPACE[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
        piece = data[at:end]
        first, last = word_spans(piece)
        p = prefix_hash(piece)
        _, down = _Tables.upto(len(piece))
        parts.append(mix((p[last] - p[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; of a text with fewer words, one of the whole; of none, none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return mix((words * _WORD_MULT[:n]).sum(keepdims=True) + np.uint64(n))
    out = words[: n - k + 1] * _WORD_MULT[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _WORD_MULT[i]
    return mix(out + np.uint64(k))


def text_views(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Each text of an Arrow string column as bytes (null: none), without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[bounds[i] : bounds[i + 1]] if valid[i] else data[:0]


def give_back() -> None:
    """Returns what this worker has freed to the system: workers are kept between tasks, and share their executor's memory.

    Called where a task begins, as what the task before held is only free once that has ended.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, tidy: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds at most ``most`` bytes, or one row; tidy: after each, memory is given back."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = np.fromiter((len(v) for v in text_views(col)), np.int64, len(col))
        at, total = 0, 0
        for i, n in enumerate(size):
            if total + n > most and i > at:
                yield batch.slice(at, i - at)
                if tidy:
                    give_back()
                at, total = i, 0
            total += n
        if at < len(col):
            yield batch.slice(at)
            if tidy:
                give_back()


class SharedFiles:
    """Files in the shared folder, written and read from tasks through Arrow's file systems.

    A file is written under a name that holds the task attempt, so a retried or
    speculative task never touches another's; only names that a finished attempt
    returned are ever read.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder = folder
        self.system, self.path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")

    def create(self, name: str):
        self.system.create_dir(self.path, recursive=True)
        return self.system.open_output_stream(f"{self.path}/{name}", compression=None)

    def open(self, name: str):
        return self.system.open_input_file(f"{self.path}/{name}")
