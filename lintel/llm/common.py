"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.sources.shared import shared_root

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "1000"
ARROW_BYTES = str(4 << 20)
WHITE = "\\x20\\x09-\\x0D"

_scopes: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a finished query's shuffle files are deleted at once; the session's setting comes back after."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and return a reader of it.

    This cuts the lineage and survives lost executors; the folder goes when the
    function marked `frees_stages` around it returns, or the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(f"{folder}/{name}")
    where, files = _folder(spark, folder)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df staged for the time of the block only."""
    _scopes.append([])
    try:
        held = staged(df, name)
    finally:
        folders = _scopes.pop()
    try:
        yield held
    finally:
        _delete(df.sparkSession, folders)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        where, files = _folder(spark, folder)
        files.delete(where, True)


def frees_stages(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is staged itself, so that all it staged on the way is deleted at once."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _scopes.append([])
        try:
            result = f(*args, **kwargs)
        finally:
            inner = _scopes.pop()
        kept = staged(result, f.__name__)
        _delete(kept.sparkSession, inner)
        return kept

    return run


Batches = Iterator[pa.RecordBatch]


def lean(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f, which gives freed memory back when its task ends: Python workers serve many tasks."""

    @functools.wraps(f)
    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def arrow_rows(spark: SparkSession, rows: str = ARROW_ROWS) -> None:
    """Whole documents travel in Arrow batches; keep a batch to a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus: a reproducible fold."""
    return F.crc32(F.col(key).cast("string")) % modulus


def width(spark: SparkSession, least: int = 1) -> int:
    """Tasks to deal a shuffle to: follows spark.sql.shuffle.partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def width_for(df: DataFrame, least: int, each: int = 8 << 20) -> int:
    """Tasks for df by the planner's estimate of its bytes, `each` a task, at most as a shuffle has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(width(df.sparkSession), size // each))


def flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in a binary column of arrays, one after another, and how many each row has; null is none."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset) if n else np.zeros(1, np.int32)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The binary column whose row i is values[cuts[i]:cuts[i + 1]]; cuts begin with 0."""
    offsets = (np.asarray(cuts, np.int64) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def carried(docs: DataFrame, without: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Two projections: of docs' columns but some to names c0, c1, ... that clash with none of ours, and back."""
    names = [c for c in docs.columns if c not in without]
    there = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return there, [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
