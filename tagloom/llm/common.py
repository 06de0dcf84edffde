"""Shared helpers: scratch tables in the cluster's shared folder, and Arrow text columns as byte arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import shared_folder

#: Rows and bytes of one Arrow batch sent to Python; a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def tidy() -> None:
    """Give memory that is free back to the system: a worker that is used again would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function over Arrow batches that tidies up when its task is done."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python operators receive. Plans read these settings when they run, so they stay with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/tagloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tagloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    path = getattr(df, "_tagloom_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one run: ``ws(df, name)`` materializes, ``clear()`` deletes all of them."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        self.made.append(materialize(df, name, compression))
        return self.made[-1]

    def drop(self, df: DataFrame) -> None:
        discard(df)
        self.made = [x for x in self.made if x is not df]

    def clear(self) -> None:
        for df in self.made:
            discard(df)
        self.made = []


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as set it apart from those that are taken."""
    out, held = [], {x.lower() for x in taken}
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """A text column in parts of at most about so many bytes, one text at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(lengths), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield column.slice(a, b - a)
        a = b


def chunks(batches: Iterator[pa.RecordBatch], size: int, at: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until the texts in column number at have at least so many bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(at).nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
            tidy()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its int64 offsets, from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column over one prepared buffer."""
    kind = kind or pa.binary()
    dtype = np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32
    if dtype is np.int32 and len(offsets) and offsets[-1] > 2**31 - 1:
        raise ValueError("a batch of over 2 GB needs a large type")
    buffers = [None, pa.py_buffer(offsets.astype(dtype).tobytes()), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a fixed bijection on 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


#: An odd multiplier and its inverse modulo 2**64, for rolling hashes of bytes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16
_TABLES: dict[str, np.ndarray] = {}


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes with is_word[byte], runs ending at text ends; and words before each text."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[: len(data)]))
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: byte values from a random table in a polynomial modulo 2**64, then mixed with the length."""
    if not _TABLES:
        rng = np.random.default_rng(7)
        _TABLES["byte"] = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        _TABLES["pow"], _TABLES["inv"] = _powers(_BASE, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)
    out = np.empty(len(starts), np.uint64)
    powers, inverse = _TABLES["pow"], _TABLES["inv"]
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + _BLOCK, side="right"))
            if j <= i:  # a word longer than the block
                w = _TABLES["byte"][data[starts[i] : ends[i]]]
                h = np.uint64(0)
                for a in range(0, len(w), _BLOCK):
                    part = w[a : a + _BLOCK]
                    h = h * powers[len(part)] + (part * powers[: len(part)]).sum(dtype=np.uint64)
                out[i] = mix(np.array([h + np.uint64(int(ends[i] - starts[i])) * np.uint64(_BASE)]))[0]
                i += 1
                continue
            a, b = int(starts[i]), int(ends[j - 1])
            total = np.empty(b - a + 1, np.uint64)
            total[0] = 0
            np.cumsum(_TABLES["byte"][data[a:b]] * powers[: b - a], out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
            i = j
    return out
