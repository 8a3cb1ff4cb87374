"""Merkle manifest of a dataset, with a witness for every record.

Every record is a leaf; the leaves of a group, in order, are hashed 16 by 16 up to the group's root, and the group roots, in
order, up to the manifest's. ``Appender`` takes the leaves of an aligned block one by one. A leaf's witness begins with the
siblings that are there when it is appended; every later sibling, and every completion of an open subtree, extends the
witnesses of what is open. Witnesses hang on the subtrees, so a sibling is attached once for all leaves below.

Blocks have ``FAN ** 3`` leaves and are appended in parallel. Their roots are the leaves of a further, shorter sequence in
which the same appending goes on, until each group has one node left; then its group root is a leaf of the top tree. Witnesses
go the other way: a block takes the witness of its own root and hands it on behind those of its leaves. A group of any size
is spread over tasks by blocks, and equal leaves of one key by their physical row.

Defined results: nulls are hashed as ``-`` and their groups and keys come first; an empty text differs from null; repeated
rows are leaves of their own, equal keys are ordered by their digest; a group of one record has its leaf as root; an empty
table gives an empty result and no root; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.shared import written

FAN, BLOCK_LEVELS = 16, 3
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings of one level, as hex text: those left and those right of the path.
STEP = "struct<left:string,right:string>"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a record: each field as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Appender:
    """Appends nodes to the open subtrees of one aligned block.

    ``levels`` open runs, one per level; a run of ``FAN`` nodes closes into a node of the next one. ``finish`` closes what is
    open. A node is (digest, children); its step stays None until its run is closed.
    """

    def __init__(self) -> None:
        self.open: list[list[list]] = []

    def append(self, digest: str) -> list:
        """A new leaf; returns its node, whose ``steps`` are known once the block is finished."""
        node = [digest, None, None]  # digest, step in its run, parent
        self._put(0, node)
        return node

    def _put(self, level: int, node: list) -> None:
        if len(self.open) == level:
            self.open.append([])
        run = self.open[level]
        # the partial witness: siblings so far; each of those is extended by this one
        node[1] = ["".join(x[0] for x in run), ""]
        for x in run:
            x[1][1] += node[0]
        run.append(node)
        if len(run) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = [h("".join(x[0] for x in run)), None, None]
        for x in run:
            x[2] = parent
        self._put(level + 1, parent)

    def finish(self, levels: int | None = None) -> str:
        """The block's root: after ``levels`` levels, or as soon as one node is left."""
        level = 0
        while True:
            rest = sum(map(len, self.open[level:]))
            if level == levels or (levels is None and rest == 1 and self.open[level]):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1

    @staticmethod
    def steps(node: list) -> list[tuple[str, str]]:
        """The witness of a leaf up to the block's root."""
        out = []
        while node[2] is not None:
            out.append((node[1][0], node[1][1]))
            node = node[2]
        return out


def fold(node: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings_digest(witness: Column) -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    text = F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "")
    return F.sha2(text, 256)


def _placed(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Written ``items`` (``group``, ``node`` and what else they carry) with ``pos`` in their group and the group's ``total``.

    Rows are sorted into ranges of (group, order, node, row), so a large group, and even one repeated record, is cut up.
    """
    numbered = written(items.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = ["group", *order, "node", "_row"]
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.drop("_row").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = ranged.groupBy("group", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_group = Window.partitionBy("group")
    before = F.sum("_n").over(by_group.orderBy("_part")) - F.col("_n")
    counts = counts.select("group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_group).alias("total"))
    return ranged.join(counts, ["group", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_part")


def _in_blocks(items: DataFrame) -> DataFrame:
    return items.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def _append_all(nodes: list[str], order: np.ndarray, total: int, size: int, levels: int) -> tuple[list[list], str]:
    """Nodes of a block, in order of position, and its root. The size and levels of a block come from the driver, which cut them."""
    block = Appender()
    made: list = [None] * len(nodes)
    for i in order.tolist():
        made[i] = block.append(nodes[i])
    return made, block.finish(levels if total > size else None)


def _roots(items: DataFrame) -> DataFrame:
    """One row per block: (group, pos, total, node), the next sequence."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        _, root = _append_all(table.column("node").to_pylist(), np.argsort(table.column("pos").to_numpy()), total, BLOCK, BLOCK_LEVELS)
        return pa.table({"group": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "node": [root]})

    return items.select("group", "block", "pos", "total", "node").groupBy("group", "block").applyInArrow(run, "group string, pos long, total long, node string")


def _witnessed(items: DataFrame, above: DataFrame | None) -> DataFrame:
    """``items`` with ``witness``, the steps inside their block and then those of the block's root, and ``top``.

    ``above`` has (group, block, witness, top), which a block hands on to its items. The two meet in one group, so rows with
    witnesses are not shuffled.
    """
    kept = [f for f in items.schema.fields if f.name not in ("block", "pos", "total")]
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def attach(table: pa.Table, upper: list[dict], top: str | None) -> pa.Table:
        n = table.num_rows
        lists = []
        if n:
            made, _ = _append_all(table.column("node").to_pylist(), np.argsort(table.column("pos").to_numpy()), table.column("total")[0].as_py(), BLOCK, BLOCK_LEVELS)
            lists = [[{"left": a, "right": b} for a, b in Appender.steps(x)] + upper for x in made]
        return pa.table({f.name: table.column(f.name) for f in kept} | {"witness": pa.array(lists, step), "top": pa.array([top] * n, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", witness array<{STEP}>, top string"
    groups = items.groupBy("group", "block")
    if above is None:
        return groups.applyInArrow(lambda table: attach(table, [], None), schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return attach(left, right.column("witness")[0].as_py(), right.column("top")[0].as_py()) if right.num_rows else attach(left, [], None)

    return groups.cogroup(above.groupBy("group", "block")).applyInArrow(both, schema)


class Tree:
    """The trees of all groups over placed items, and their roots."""

    def __init__(self, items: DataFrame, order: Sequence[str]):
        self.layers = [written(_in_blocks(_placed(items, order)), "placed")]
        longest = self.layers[0].agg(F.max("total")).first()[0] or 0
        while True:
            roots = written(_in_blocks(_roots(self.layers[-1])), "roots")
            if longest <= BLOCK:
                break
            self.layers.append(roots)
            longest = -(-longest // BLOCK)
        self.roots = roots.select("group", "node")

    def witnessed(self, above: DataFrame | None = None) -> DataFrame:
        """The items with their witnesses; ``above`` (group, witness, top) is what follows behind each group's root."""
        upper = None if above is None else above.select("group", F.lit(0).cast("long").alias("block"), "witness", "top")
        for layer in reversed(self.layers[1:]):
            done = _witnessed(layer.withColumn("at", F.col("pos")), upper)
            upper = written(done.select("group", F.col("at").alias("block"), "witness", "top"), "witnesses")
        return _witnessed(self.layers[0], upper)


def manifest(docs: DataFrame, id_column: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, carry: Callable[[DataFrame], dict[str, Column]] | None = None) -> DataFrame:
    """(id, ``leaf``, ``subroot``, ``root``, ``witness``) of every record; ``witness`` has one step of siblings per level.

    ``carry`` names further columns that are computed from ``docs`` beside the leaves and come along.
    """
    more = carry(docs) if carry else {}
    # null first, then by bytes
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(F.col(f"`{id_column}`").alias("key"), name.alias("group"), leaf([F.col(f"`{c}`") for c in fields]).alias("node"), *[c.alias(n) for n, c in more.items()])
    per_group = Tree(leaves, ["key"])
    top = Tree(per_group.roots.select(F.lit("").alias("group"), F.col("group").alias("key"), "node"), ["key"])
    root = top.roots.first()
    subroots = top.witnessed().select(F.col("key").alias("group"), "witness", F.col("node").alias("top"))
    done = per_group.witnessed(written(subroots, "subroots"))
    return done.select(
        F.col("key").alias(id_column), F.col("node").alias("leaf"), F.col("top").alias("subroot"), F.lit(root["node"] if root else None).cast("string").alias("root"), "witness", *more
    )
