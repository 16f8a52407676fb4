"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked through in slices of about this many UTF-8 bytes, so a task's memory
#: doesn't depend on how many rows Spark puts in an Arrow batch. A longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one beside the warehouse where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return a scan of it.

    Cuts lineage with files that outlive any executor; several jobs can then read one
    consistent copy. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    with contextlib.suppress(Exception):  # tidying up only
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before them where a table with these names has them already (names differ in more than case)."""
    taken = {n.lower() for n in names}
    return [next(x for k in count() if (x := "_" * k + w).lower() not in taken) for w in wanted]


def release() -> None:
    """Gives memory that is free back to the system: Python workers serve many tasks and stages, and what one leaves unused adds up in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc do without
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with release at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def as_string(column: pa.Array) -> pa.Array:
    """A null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offset at which each value starts, with the end last."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    _, offsets, data = texts.cast(wide).buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    every = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    _, at = raw_bytes(texts)
    start, n = 0, len(texts)
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, end
        start = end
