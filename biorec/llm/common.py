"""Helpers shared by the corpus operators: shared storage, text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a character class for Java and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that operators make in the shared one while this is entered, for ``free``."""
    paths: list[str] = []
    before = _SCRATCH.set(paths)
    try:
        yield paths
    finally:
        _SCRATCH.reset(before)


def free(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Delete these folders, but those that ``docs`` still reads from."""
    used = docs.inputFiles() if paths else []
    for p in paths:
        if not any(f"{p.split(':', 1)[-1].lstrip('/')}/" in f for f in used):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many narrow rows is broadcast, some tens of megabytes at most.
MOST_BROADCAST = 200_000


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a materialised table of narrow rows, to be broadcast if its counted rows are few, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number for each row, ``_row``, fixed in a table of the shared folder."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as text, for seeds and folds; a null id is the text ``null``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_key(column)), F.lit(4))


# ---------------------------------------------------------------- text buffers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, so that a batch never needs memory in proportion to its whole text."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


#: What Spark hands to a Python worker at a time, and a worker to Spark: an executor's memory holds both sides of it, for each worker of each task.
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks exchange small batches with their Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan``, after whose task the Python worker gives back the memory that it has freed: workers are kept for later tasks, beside other work."""

    @functools.wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        release_memory()

    return run


def release_memory() -> None:
    """Free pages go back to the system, where its C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers (fixed values of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) and the words' rows; words are runs without white space."""
    first, last = int(offsets[0]), int(offsets[-1])
    b = data[first:last]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    bounds = offsets - first
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(b)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after)
    lower = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    size = 1 << max(18, int(len(b)).bit_length())
    power, inverse = _powers(size)
    sums = np.cumsum(_BYTE[lower] * power[: len(b)], dtype=np.uint64)
    left = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], np.uint64(0))
    words = mix((sums[stops] - left) * inverse[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(bounds, starts, side="right") - 1


# ---------------------------------------------------------------- sketches of a fixed size


def merged_sketch(parts: DataFrame, size: int, dtype: str, merge: np.ufunc = np.add) -> np.ndarray:
    """Merge arrays that tasks emitted in pieces as (piece, blob); sums stop at the type's maximum.

    The result has ``size`` entries whatever the input: that is the bound on what reaches the driver.
    """
    wide = np.uint64 if merge is np.add else dtype

    def add(group: pa.Table) -> pa.Table:
        total = None
        for blob in group["blob"]:
            x = np.frombuffer(blob.as_buffer(), dtype)
            total = x.astype(wide) if total is None else merge(total, x)
        top = np.minimum(total, np.iinfo(dtype).max).astype(dtype)
        return pa.table({"piece": group["piece"][:1], "blob": pa.array([top.tobytes()], pa.binary())})

    out = np.zeros(size, dtype)
    for row in parts.groupBy("piece").applyInArrow(add, "piece int, blob binary").collect():
        x = np.frombuffer(row["blob"], dtype)
        out[row["piece"] * len(x) : (row["piece"] + 1) * len(x)] = x
    return out


def pieces(array: np.ndarray, count: int = 64) -> pa.RecordBatch:
    size = len(array) // count
    blobs = [array[i * size : (i + 1) * size].tobytes() for i in range(count)]
    return pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "blob"])


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Label each vertex of ``edges(u, v)`` with the smallest vertex it is connected to: ``(u, label)``.

    Alternating large-star and small-star steps; each step's edges are written to the shared
    folder, and the write itself observes their number and checksum. A vertex with very many
    neighbours is reduced by partial ``min`` aggregates, and the join that follows can be split by
    adaptive execution. Vertices of no edge are absent.
    """

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        marked = df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        return materialize(marked, name), (seen.get["n"], seen.get["x"])

    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = step(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: a vertex's smaller neighbours and itself are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, got = step(tied.unionByName(low.withColumnRenamed("m", "v")).distinct())
        if got == seen:
            return now.select("u", F.col("v").alias("label"))
        seen = got
