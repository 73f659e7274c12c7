"""Shared helpers of the corpus operators: work folders, Arrow text buffers, chunking."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weftline import ensure_importable

#: Bytes of text that one vectorised step handles at once; temporaries are about 60 times this.
CHUNK_BYTES = 1 << 20


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode (tests, a laptop), where that setting may be missing, a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("weftline.work.dir", None)
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
            spark.conf.set("weftline.work.dir", base)
    return f"{base.rstrip('/')}/weftline/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared work folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Frees what the driver holds of work that is done: its plans, broadcasts and shuffle files, and the heap that they needed."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * arr.offset) if n else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a row is never cut."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def expand(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[starts[i] : starts[i] + lens[i]]`` for each i of ``ids``."""
    size = lens[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.arange(total) + np.repeat(starts[ids] - (end - size), size)]


#: Rows of an Arrow batch, where the session leaves that at Spark's default: texts can be long.
BATCH_ROWS = 2000
#: Bytes of an Arrow batch, where the session leaves that at Spark's default: rows can be long.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What every operator with Python workers needs of the session."""
    ensure_importable(spark)
    for name, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "64m", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) in (None, default, "67108864b", "67108864"):
            spark.conf.set(name, str(ours))


def release() -> None:
    """Gives memory that a task no longer uses back to the system: workers live on after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory released when its partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped
