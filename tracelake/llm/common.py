"""Helpers shared by the training-data operators: shared tables, and words as numpy arrays."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time; a longer text is a pass of its own.
PASS_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets a fresh one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tracelake-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, tag)
    out = df.write.option("compression", codec)
    out.partitionBy(*partition_by).parquet(path) if partition_by else out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def apart(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with names of their own for all columns but the needed ones, so that none clashes with an operator's, and what gives the old names and order back."""
    new = {c: c if c in needed else f"_kept{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*(quoted(c).alias(n) for c, n in new.items())), [F.col(n).alias(c) for c, n in new.items()]


class Scratch:
    """Staged tables of one job, deleted by name once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            dropped(self.spark, *self.paths.pop(name, ()))


#: Parts that many rows go by, at most, and from how many rows on there is one more.
PARTS, PART_ROWS = 4, 1 << 22


def in_parts(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """df's rows by parts of a column of hashes, few where they are few: what shuffles them holds one part on disk at a time."""
    n = min(PARTS, 1 + rows // PART_ROWS)
    return [df.where(F.pmod(key, F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def chosen_share(key: Column, share: float) -> Column:
    """True for about that share of all 64-bit hashes, however small it is: a sample of bounded size from any number of rows."""
    return F.lit(True) if share >= 1 else key < F.lit(int(share * 2.0**64) - (1 << 63)).cast("long")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end after a few MB, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def freed_shuffles(spark: SparkSession) -> None:
    """Lets each statement's shuffle files go when it ends, not when the driver happens to collect garbage; what is needed later is staged."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system when a task ends: workers are reused, and an executor's memory is shared."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None
    if trim is not None:
        trim(0)


def passes(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes; every row is in exactly one of them."""
    at = batch.schema.get_field_index(column)
    size = np.diff(text_bytes(batch.column(at))[1])
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and where each begins (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PASS_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within each text, and each text's first word (one more entry)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from prefix sums over the whole array."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
