"""Shared helpers: tables, stable row numbers and the removal of rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.storage import materialize, scratch_path

ROW = "__row"
FILE = "__file"
#: Bits of a row number for the place within the file.
PLACE_BITS = 36
#: Keys that may be broadcast at most; each takes 8 bytes, so the table stays under 32 MB.
BROADCAST_KEYS = 4_000_000
#: Rows of texts that are worked on at once.
SLICE = 512
#: File names that may be broadcast at most.
BROADCAST_FILES = 200_000


#: What a task keeps between its batches.
_KEPT: list[dict] = []


def kept_in_task() -> dict:
    """A cache that is empty again when a task ends (see ``give_back``)."""
    _KEPT.append({})
    return _KEPT[-1]


def give_back() -> None:
    """Forget what was kept, and return free memory: a worker lives on for later stages, what its task needed shouldn't."""
    for cache in _KEPT:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, giving memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows, so that what is derived from one part stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that stays the same however often, and however split, the rows are read.

    For a scan of files it is the number of the file (in order of their paths) and the row's place within the file. Rows
    that come from anything else are written with their numbers first, and rows with numbers are left alone.
    """
    if ROW in docs.columns:
        return docs
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column hides what is known of files")
        rows = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    paths = docs.select(F.col("_metadata.file_path").alias(FILE)).distinct().toPandas()[FILE].sort_values()  # names of files only
    spark = docs.sparkSession
    if len(paths) == 1:
        return rows.drop(FILE)
    files = spark.createDataFrame([(p, k << PLACE_BITS) for k, p in enumerate(paths)], f"{FILE} string, __base long")
    if len(paths) <= BROADCAST_FILES:
        files = F.broadcast(files)
    return rows.join(files, FILE).withColumn(ROW, F.col(ROW) + F.col("__base")).drop(FILE, "__base")


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The ``numbered`` rows minus those whose number is in ``gone``, without their numbers.

    The list of numbers is counted first: up to BROADCAST_KEYS it is broadcast, beyond it both sides are shuffled.
    """
    gone = materialize(gone.select(ROW), "gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return rows.join(gone, ROW, "left_anti").drop(ROW)


__all__ = ["BROADCAST_KEYS", "ROW", "give_back", "kept_in_task", "materialize", "numbered", "read_table", "scratch_path", "sliced", "tidy", "without_rows"]
