"""Ordered computations that do not put a whole meeting into one task.

A window partitioned by meeting sends all rows of that meeting to one task, and a single meeting may hold a large
share of the corpus. Every function here works on (meeting, bucket) instead, where the bucket is a coarse slice of
the ordering column:

* ``scan`` computes running aggregates inside each bucket, the same aggregates over one summary row per bucket, and
  adds the two. Only the summary is windowed per meeting.
* ``frames`` serves bounded frames (a few rows before and after) by copying the rows near a bucket edge to the
  neighbouring bucket.
* ``exact_percentile`` finds the two order statistics through a histogram per meeting.
* ``ordered_pass`` and ``block_pass`` are for rules whose next step depends on their own output; they keep one small
  state per key and never hold a group in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import cut_lineage

BUCKET = "_slice"
ROWS_PER_BUCKET = 4096


def by_index(name: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """Slice of a dense integer index."""
    return F.floor(F.col(name) / F.lit(rows)).cast("long")


def by_time(name: str, seconds: float = 3600.0) -> Column:
    """Slice of a time column in seconds."""
    return F.floor(F.col(name) / F.lit(float(seconds))).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    specs: dict[str, tuple[str, Column | str]],
    keep: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Add running columns. ``keep`` leaves the slice column in place, and ``bucket=None`` then takes it up again, so
    that a chain of scans shuffles the rows once. ``bucket`` must not decrease along ``order``; ``order`` must be total within ``keys``.
    ``tasks`` deals the rows to that many tasks, so that a task's share does not depend on the session.

    Kinds: ``sum``, ``max``, ``last`` (latest non-null up to the row), ``next`` (first non-null from the row on),
    the same with ``_before`` / ``_after`` to leave the row out, ``first`` (earliest non-null up to the row), ``lag`` and
    ``lead``. A column given by its name is shuffled once, whatever the number of kinds that read it.
    """
    keys, order = list(keys), list(order)
    inputs = {f"_in_{name}": expr for name, (_, expr) in specs.items() if not isinstance(expr, str)}
    rows = (df if bucket is None else df.withColumn(BUCKET, bucket)).withColumns(inputs)
    up = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    down = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(c).desc() for c in order])
    first, cur = Window.unboundedPreceding, Window.currentRow

    local, summary, carry, result = {}, [], {}, {}
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    back = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc())
    for name, (kind, expr) in specs.items():
        src, own, tot, car = F.col(expr if isinstance(expr, str) else f"_in_{name}"), f"_own_{name}", f"_tot_{name}", f"_car_{name}"
        at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], src.alias("v"))
        base, _, side = kind.partition("_")
        end = -1 if side else cur
        if base == "sum":
            local[own] = F.sum(src).over(up.rowsBetween(first, end))
            summary.append(F.sum(src).alias(tot))
            carry[car] = F.sum(tot).over(across.rowsBetween(first, -1))
            zero = F.lit(0)
            result[name] = F.coalesce(F.col(own), zero) + F.coalesce(F.col(car), zero)
        elif base == "max":
            local[own] = F.max(src).over(up.rowsBetween(first, end))
            summary.append(F.max(src).alias(tot))
            carry[car] = F.max(tot).over(across.rowsBetween(first, -1))
            result[name] = F.greatest(own, car)
        elif base == "last":
            local[own] = F.last(src, ignorenulls=True).over(up.rowsBetween(first, end))
            summary.append(F.max(F.when(src.isNotNull(), at)).alias(tot))
            carry[car] = F.last(tot, ignorenulls=True).over(across.rowsBetween(first, -1))
            result[name] = F.coalesce(F.col(own), F.col(car)["v"])
        elif base == "next":
            local[own] = F.last(src, ignorenulls=True).over(down.rowsBetween(first, end))
            summary.append(F.min(F.when(src.isNotNull(), at)).alias(tot))
            carry[car] = F.last(tot, ignorenulls=True).over(back.rowsBetween(first, -1))
            result[name] = F.coalesce(F.col(own), F.col(car)["v"])
        elif base == "first":
            local[own] = F.first(src, ignorenulls=True).over(up.rowsBetween(first, end))
            summary.append(F.min(F.when(src.isNotNull(), at)).alias(tot))
            carry[car] = F.first(tot, ignorenulls=True).over(across.rowsBetween(first, -1))
            result[name] = F.coalesce(F.col(car)["v"], F.col(own))
        elif base in ("lag", "lead"):
            move = F.lag if base == "lag" else F.lead
            local[own] = move(F.struct(src.alias("v"))).over(up)
            summary.append((F.max(at) if base == "lag" else F.min(at)).alias(tot))
            carry[car] = move(tot).over(across)
            result[name] = F.when(F.col(own).isNotNull(), F.col(own)["v"]).otherwise(F.col(car)["v"])
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    totals = rows.groupBy(*keys, BUCKET).agg(*summary)
    carried = totals.withColumns(carry).select(*keys, BUCKET, *carry)
    dealt = rows if tasks is None else rows.repartition(tasks, *keys, BUCKET)
    joined = dealt.withColumns(local).join(carried, [*keys, BUCKET], "left")
    kept = [c for c in rows.columns if c not in result and c not in inputs and (keep or c != BUCKET)]
    return joined.select(*kept, *[expr.alias(name) for name, expr in result.items()])


def frames(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    behind: int,
    ahead: int,
    columns: Callable[[Window], dict[str, Column]],
    rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Window columns whose frame stays within ``behind`` rows before and ``ahead`` after. ``index`` is dense."""
    rows = max(rows, behind + ahead + 1)
    home = F.floor(F.col(index) / F.lit(rows)).cast("long")
    spot = F.pmod(F.col(index), F.lit(rows))
    copies = F.array_compact(
        F.array(
            home,
            F.when(spot < ahead, home - 1),
            F.when(spot >= rows - behind, home + 1),
        )
    )
    spread = df.withColumn(BUCKET, F.explode(copies))
    win = Window.partitionBy(*keys, BUCKET).orderBy(index)
    return spread.withColumns(columns(win)).filter(F.col(BUCKET) == home).drop(BUCKET)


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """1-based position within the key."""
    return scan(df, keys, order, bucket, {name: ("sum", F.lit(1).cast("long"))})


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Sequence[str],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    name: str = "island",
) -> DataFrame:
    """Number the runs of rows. ``starts(cur, prev)`` tells from the named columns of two neighbouring rows whether the
    later one opens a run; the first row always does.

    Inside a slice the test runs on the rows; between slices it runs on the summary, which holds the first and last row
    of each slice.
    """
    keys, order = list(keys), list(order)
    here = F.struct(*[F.col(c).alias(c) for c in columns])
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], here.alias("v"))
    win = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    prev, no = F.col("_prev"), F.lit(False)
    opens = F.coalesce(starts(F.col, lambda c: prev[c]), no).cast("long")
    rows = (
        df.withColumn(BUCKET, bucket)
        .withColumn("_prev", F.lag(here).over(win))
        .withColumn("_opens", F.when(prev.isNull(), F.lit(0)).otherwise(opens))
    )
    summary = rows.groupBy(*keys, BUCKET).agg(
        F.sum("_opens").alias("_inside"), F.min(at).alias("_first"), F.max(at).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    left = F.col("_left")["v"]
    edge = F.coalesce(starts(lambda c: F.col("_first")["v"][c], lambda c: left[c]), no).cast("long")
    base = F.sum(F.col("_inside") + F.col("_edge")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        summary.withColumn("_left", F.lag("_last").over(across))
        .withColumn("_edge", F.when(F.col("_left").isNull(), F.lit(1)).otherwise(edge))
        .select(*keys, BUCKET, (F.coalesce(base, F.lit(0)) + F.col("_edge")).alias("_base"))
    )
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_own", F.sum("_opens").over(upto)).join(carried, [*keys, BUCKET], "left")
    return numbered.withColumn(name, F.col("_base") + F.col("_own")).select(*df.columns, name)


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, bins: int = 4096
) -> DataFrame:
    """Linear-interpolated percentile per key, exact. Returns keys, ``n`` and ``pct``.

    Distinct values are counted first (map-side), then a histogram of at most ``bins`` rows per key tells which bins
    hold the two order statistics, and only those bins are sorted. The counts are read three times, so they are written
    down once.
    """
    keys = list(keys)
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    at = F.try_divide((F.col("_v") - F.col("_lo")) * F.lit(bins), F.col("_hi") - F.col("_lo"))
    binned = counts.join(span, keys).withColumn(
        BUCKET, F.coalesce(F.least(F.floor(at), F.lit(bins - 1)), F.lit(0)).cast("long")
    )
    place = F.col("n") - 1
    pos = F.lit(float(p)) * place
    hist = binned.groupBy(*keys, BUCKET).agg(F.sum("_c").alias("_h"), F.first("n").alias("n"))
    below = F.coalesce(
        F.sum("_h").over(Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    lo_rank, hi_rank = F.floor(pos), F.ceil(pos)
    wanted = (
        hist.withColumn("_below", below)
        .filter(
            ((F.col("_below") <= lo_rank) & (lo_rank < F.col("_below") + F.col("_h")))
            | ((F.col("_below") <= hi_rank) & (hi_rank < F.col("_below") + F.col("_h")))
        )
        .select(*keys, BUCKET, "_below")
    )
    upto = Window.partitionBy(*keys, BUCKET).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = binned.join(wanted, [*keys, BUCKET]).withColumn("_cum", F.col("_below") + F.sum("_c").over(upto))
    picked = ranked.groupBy(*keys, "n").agg(
        F.min(F.when(F.col("_cum") > lo_rank, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > hi_rank, F.col("_v"))).alias("_b"),
    )
    return picked.select(
        *keys, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * (pos - F.floor(pos))).alias("pct")
    )


def ordered_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], Iterable[tuple]],
    finish: Callable[[object], Iterable[tuple]],
    schema: str,
) -> DataFrame:
    """Run ``step`` over the rows of each key in order, with one small state per key.

    Rows arrive sorted, in Arrow batches, so memory does not grow with the group. ``step`` and ``finish`` return rows
    without the key columns, which are put in front. ``schema`` names the output, key columns included.
    """
    keys, columns = list(keys), list(columns)
    nkeys = len(keys)
    names = [part.strip().split()[0].strip("`") for part in schema.split(",")]
    sorted_rows = (
        df.select(*keys, *columns, *[c for c in order if c not in columns and c not in keys])
        .repartition(*keys)
        .sortWithinPartitions(*keys, *order)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                here = row[:nkeys]
                if here != key:
                    if key is not None:
                        out.extend((*key, *r) for r in finish(state))
                    key, state = here, start()
                out.extend((*key, *r) for r in step(state, row[nkeys : nkeys + len(columns)]))
            yield pd.DataFrame.from_records(out, columns=names)
        if key is not None:
            yield pd.DataFrame.from_records([(*key, *r) for r in finish(state)], columns=names)

    return sorted_rows.mapInPandas(run, schema)


def block_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    rule: Callable[[], object],
    schema: str,
) -> DataFrame:
    """Like ``ordered_pass`` for rules that work on whole blocks.

    ``rule()`` makes the state of a key. Its ``feed`` takes the next rows of the key, at most one Arrow batch, as arrays by
    column name; its ``close`` is called at the end of the key. Both return rows without the key columns.
    """
    keys, columns = list(keys), list(columns)
    names = [part.strip().split()[0].strip("`") for part in schema.split(",")]
    sorted_rows = (
        df.select(*keys, *columns, *[c for c in order if c not in columns and c not in keys])
        .repartition(*keys)
        .sortWithinPartitions(*keys, *order)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            out = []
            rows = {c: batch[c].to_numpy() for c in columns}
            head = [batch[c].to_numpy() for c in keys]
            moved = np.any([h[1:] != h[:-1] for h in head], axis=0)
            edges = [0, *(np.flatnonzero(moved) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                here = tuple(h[a] for h in head)
                if here != key:
                    if key is not None:
                        out.extend((*key, *r) for r in state.close())
                    key, state = here, rule()
                out.extend((*key, *r) for r in state.feed({c: v[a:b] for c, v in rows.items()}))
            yield pd.DataFrame.from_records(out, columns=names)
        if key is not None:
            yield pd.DataFrame.from_records([(*key, *r) for r in state.close()], columns=names)

    return sorted_rows.mapInPandas(run, schema)
