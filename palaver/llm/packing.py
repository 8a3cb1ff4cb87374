"""Packing of documents into sequences of a fixed length by exact complements.

Only the counts of the lengths decide which lengths go together, and there are at most ``capacity`` of them, so the plan is
made on one small histogram, whatever the number of documents. Sequences are opened with the longest piece left; the gap is
closed exactly by one, two or three lengths whose sum is the gap, as often as their counts allow; where no such sum is
available the longest piece that fits goes in (best fit) and the gap is looked at again. A row of the plan stands for all
sequences of one make-up. Pieces then get their places by their rank within their length: ranks are counted per task and
added up over tasks by a small table, so no length is brought together in one place.

Defined results: a null or empty text is one piece (the end token); repeated rows are packed as often as they occur; an
empty table gives an empty result; only ``id_column`` and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import columns as C
from palaver.llm.bpe import codec
from palaver.llm.shared import tidy, written

CAPACITY, END_ID = 1024, 2
#: The plan in ``assign`` goes to every task: at most so many pieces of make-ups per length.
PLAN_COLUMNS = ("length", "low", "base", "offset")


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` (binary; with ``digest`` ``ids_crc32`` in its place), and
    its place among the pieces of its length in its task (``task``, ``rank``). Longer documents are cut so that only the first
    piece is shorter."""
    id_type, name = docs.schema[id_column].dataType.simpleString(), "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task = codec(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in C.split(batches, "text"):
            row = 0
            for ids, offsets in c.encode_column(batch.column("text")):
                n = len(offsets) - 1
                whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
                ends = offsets[1:] + np.arange(1, n + 1)
                size = np.diff(np.append(0, ends))
                count = -(-size // capacity)
                owner = np.repeat(np.arange(n), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                head = size - (count - 1) * capacity
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                length = np.where(number == 0, head[owner], capacity)
                order = np.argsort(length, kind="stable")
                sizes, first = np.unique(length[order], return_index=True)
                rank = np.empty(len(length), dtype=np.int64)
                spread = np.diff(np.append(first, len(length)))
                rank[order] = np.arange(len(length)) - np.repeat(first, spread) + np.repeat(seen[sizes], spread)
                seen[sizes] += spread
                bounds = np.append(0, np.cumsum(length)).astype("<i4") * 4
                if digest:
                    raw, at = memoryview(whole.tobytes()), bounds.tolist()
                    content = pa.array([zlib.crc32(raw[lo:hi]) for lo, hi in zip(at, at[1:])], pa.int64())
                else:
                    content = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column).take(pa.array(owner + row)), pa.array(number.astype("i4")), pa.array(start), pa.array(length),
                        content,
                        pa.array(np.full(len(length), task, dtype="i4")), pa.array(rank),
                    ],
                    [id_column, "piece", "start", "length", name, "task", "rank"],
                )
                row += n

    schema = f"`{id_column}` {id_type}, piece int, start long, length long, {name} {'long' if digest else 'binary'}, task int, rank long"
    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Make-ups and how often each is used: [(lengths in order, times)]. Every piece is used exactly once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []

    def fits(parts: list[int]) -> bool:
        return all(left[p] >= parts.count(p) for p in set(parts))

    def closing(used: list[int], gap: int) -> list[int] | None:
        """One, two or three further lengths with exactly the sum ``gap``; the longest come first."""
        if left[gap] > used.count(gap):
            return [gap]
        free = left[: gap + 1].copy()
        for p in used:
            if p <= gap:
                free[p] -= 1
        have = free > 0
        have[0] = False
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        both = a[have[a] & have[gap - a]]
        for x in both.tolist():
            if fits([*used, x, gap - x]):
                return [x, gap - x]
        for x in range(gap - 2, 0, -1):
            if not have[x] or 3 * x < gap:
                continue
            rest = gap - x
            y = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
            for z in y[have[y] & have[rest - y]].tolist():
                if fits([*used, x, z, rest - z]):
                    return [x, z, rest - z]
        return None

    while (lengths := np.flatnonzero(left)).size:
        parts = [int(lengths[-1])]
        gap = capacity - parts[0]
        while gap:
            if (rest := closing(parts, gap)) is not None:
                parts += rest
                break
            free = left[: gap + 1].copy()
            for p in parts:
                if p <= gap:
                    free[p] -= 1
            some = np.flatnonzero(free[1:] > 0)
            if not some.size:
                break
            parts.append(int(some[-1]) + 1)
            gap -= parts[-1]
        times = min(int(left[p]) // parts.count(p) for p in set(parts))
        for p in parts:
            left[p] -= times
        out.append((parts, times))
    return out


def layout(made: list[tuple[list[int], int]]) -> np.ndarray:
    """The plan by length: rows (length, low, base, offset), sorted. Rank r of a length belongs to the last row with
    low <= r; its sequence is base + r - low and its place there ``offset``."""
    rows, low, base = [], {}, 0
    for parts, times in made:
        at = 0
        for p in parts:
            rows.append((p, low.get(p, 0), base, at))
            low[p] = low.get(p, 0) + times
            at += p
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces (``task``, ``length``, ``rank`` and what else they carry)."""
    per_task = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = layout(plan(totals, capacity))
    before = F.sum("n").over(_by_length())
    shift = per_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"), (before - F.col("n")).alias("_before"))
    joined = cut.join(shift, (cut["task"] == shift["_task"]) & (cut["length"] == shift["_length"])).drop("_task", "_length")
    step = np.int64(1) << 44
    keys = table[:, 0] * step + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, add = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank", "_before"))
            rank = rank + add
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1] if len(at) else rank
            offset = table[at, 3] if len(at) else rank
            yield C.extend(batch, {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return C.map_batches(joined, run, {"sequence_id": "long", "offset": "long"}).drop("task", "rank", "_before")


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """Packed pieces with their ids; with ``digest`` only their ``ids_crc32``, and no ids are written."""
    cut = written(pieces(docs, path, id_column, text, capacity, end_id, digest), "pieces")
    return assign(cut, capacity)
