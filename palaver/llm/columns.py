"""Arrow batches that keep the columns of their table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.shared import small_batches, tidy

#: Rows are handled in slices of about so many bytes, whatever the size of a batch.
SLICE_BYTES = 8 << 20


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def split(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column ``name`` has about ``SLICE_BYTES`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(name).nbytes)))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def extend(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns; a column of the same name is replaced."""
    keep = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in more}
    return pa.RecordBatch.from_arrays([*keep.values(), *more.values()], [*keep, *more])


def map_batches(df: DataFrame, run: Callable, more: dict[str, str]) -> DataFrame:
    """``mapInArrow`` whose result has the table's columns and the named ones. Names are told apart as they are written;
    a column whose name clashes with an output column, whatever its case, is left out."""
    small_batches(df.sparkSession)
    taken = {n.lower() for n in more}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken or f.name in more]
    df = df.select(*[F.col(f"`{f.name}`") for f in kept])
    fields = [f for f in kept if f.name not in more] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items()]
    return df.mapInArrow(tidy(run), T.StructType(fields))
