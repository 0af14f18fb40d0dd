"""What the operators of this package share: tables, the shared folder, and numpy kernels over the bytes of many texts at once."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch and bytes of a batch that a Python kernel takes at once.
BATCH_ROWS = 2000
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, alike for all operators; the shared folder must be known."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints (spark.checkpoint.dir). Where it is unset, a session on this machine alone, as in tests,
    gets a folder of its own; on a cluster that is an error, as the other machines would not see it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark removes the shuffle files of a finished action at once where this is set; it is set for the length of one write only.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written to the shared folder and read again, which cuts the lineage; what was shuffled for it is removed by Spark when the
    table stands. Whoever stores a table discards it after its last reader has run; what a returned frame reads stays."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
        if (made := _made.get()) is not None:
            made.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def scratch_deleted(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored inside it, in this thread, without a path of its own. For callers who have written by
    then whatever they want to keep."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        removed_from(spark, made)


def removed_from(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables by the session's own file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for frame in frames:
        if frame is not None:
            removed_from(frame.sparkSession, [frame.stored_at])


def give_back() -> None:
    """The Python worker, which goes on to other work, returns the memory it has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Callable) -> Callable:
    """A kernel over Arrow batches that gives its memory back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def lean_groups(kernel: Callable) -> Callable:
    """The same for a kernel over the tables of a group."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return kernel(group)
        finally:
            give_back()

    return run


def lean_cogroups(kernel: Callable) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return kernel(left, right)
        finally:
            give_back()

    return run


def own(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, under names of the operator's own, so that further columns of the input can't clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def keyed(frame: DataFrame, rest: str) -> StructType:
    """The schema of a kernel that hands a frame's row_key on, with the columns of `rest` after it."""
    return StructType([frame.schema["row_key"], *frame.sparkSession.createDataFrame([], rest).schema.fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the bounds of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, bounds - bounds[0]


def chunked(body: np.ndarray, bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of about `limit` bytes together: first and last row, their bytes, their bounds. A longer text comes alone."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield first, last, body[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def words(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words, which are runs without ASCII white space inside one row."""
    inside = np.zeros(len(body) + 2, bool)
    np.logical_not(SPACE[body], out=inside[1:-1])
    cut = np.zeros(len(body) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def in_pieces(size: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of spans of about `limit` bytes together."""
    upto = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + limit, "right")))
        yield slice(first, last)
        first = last


def places_of(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes of spans, end to end, and each one's place within its span."""
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return within + np.repeat(starts, size), within


def gathered(body: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, end to end."""
    parts = [body[places_of(starts[k], size[k])[0]] for k in in_pieces(size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span; spans are not empty. What is held beside is bounded by a piece, not by all bytes."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    for k in in_pieces(length):
        place, within = places_of(starts[k], length[k])
        values = body[place].astype(np.uint64)
        values += np.uint64(1)
        values *= powers(int(length[k].max()))[within]
        out[k] = np.add.reduceat(values, np.cumsum(length[k]) - length[k])
    return mix(out + length.astype(np.uint64) * _M1)
