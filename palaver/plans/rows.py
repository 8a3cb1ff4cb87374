"""Small shared expressions for grouped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(value: str, order: str, sep: str = "\\n") -> Column:
    """Values of a group joined in order; NULLs are left out."""
    return F.expr(f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})")


#: Rows that one task sorts at most, if they are dealt evenly.
ROWS_IN_TASK = 500_000


def tasks_for(written: DataFrame) -> int:
    """Tasks for a table that was written down (its rows are counted from the files): at least one per core, and so many that
    a task's share stays the same however long the table is."""
    return max(written.sparkSession.sparkContext.defaultParallelism, -(-written.count() // ROWS_IN_TASK))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on text that comes in fewer splits than there are cores, as one small file does. With splits enough
    the rows stay where they are, so a large table is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
