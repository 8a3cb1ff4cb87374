"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palaver.session import shared_dir


#: Rows of an Arrow batch: texts of many kilobytes must not fill a Python worker.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def new_path(spark: SparkSession, what: str) -> str:
    small_batches(spark)
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "step", codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which gives freed memory back to the system at its end: workers live on in later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped
