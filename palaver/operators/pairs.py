"""All pairs of vectors of a meeting, in block products, without a row per pair.

The usable vectors of a meeting are packed into blocks of fixed size; every two blocks of a meeting meet once, and a task makes
their products and gives back only what is asked: counts per bin of the cosine, or each row's nearest neighbours in the other
block. So a meeting of n vectors moves (n / ``BLOCK``) ** 2 pairs of blocks and never n ** 2 rows.

Order statistics are found by narrowing down. The cosine is written as a whole number of ``3 * BIN_BITS`` bits; three passes count
pairs by its leading, middle and last bits among the pairs that share the bits found so far. The result is within 2^-38 of the
cosine, for any number of pairs and of ties.

A vector that is null, empty, zero, or has a null or non-finite component is not usable: it is in no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import vectors
from palaver.session import cut_lineage

BLOCK = 256
#: Rows of long arrays that a task turns into Python objects at once.
ROWS_AT_ONCE = 64
BIN_BITS, PASSES = 13, 3
BINS = 1 << BIN_BITS
#: Pairs of equal labels, of different ones, and all.
SAME, OTHER, ALL = "same", "other", "all"
KEY = ["meeting_id"]


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable_only(vecs: DataFrame) -> DataFrame:
    return vecs.filter(usable(F.col("embedding")))


def blocks(vecs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Written blocks (meeting_id, block, ids, labels, values): unit vectors behind one another.

    The number of a block is that of the vectors' indexes, so gaps in the index only make a block smaller.
    """
    rows = usable_only(vecs).select(*KEY, "sub_idx", "label", vectors.l2_normalize(F.col("embedding"), 0.0).alias("v"))
    packed = rows.groupBy(*KEY, F.floor(F.col("sub_idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("sub_idx", "label", "v"))).alias("r"))
    return cut_lineage(
        packed.select(
            *KEY, "block", F.transform("r", lambda x: x["sub_idx"].cast("long")).alias("ids"),
            F.transform("r", lambda x: x["label"].cast("string")).alias("labels"), F.flatten(F.transform("r", lambda x: x["v"])).alias("values"),
        )
    )


def met(packed: DataFrame) -> DataFrame:
    """Every two blocks of a meeting, also a block with itself, once: a row has both. Dealt by (meeting, block, block)."""
    numbers = packed.select(*KEY, "block")
    both = numbers.join(numbers.withColumnRenamed("block", "other"), KEY).filter("block <= other")
    left = packed.select(*KEY, "block", *[F.col(c).alias(f"{c}_a") for c in ("ids", "labels", "values")])
    right = packed.select(*KEY, F.col("block").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "labels", "values")])
    return both.join(left, [*KEY, "block"]).join(right, [*KEY, "other"])


def few(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows, some at a time: a row with long arrays takes many times its size as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """The columns of each row but the values, and the cosines. Every cosine is summed in the same order, so equal vectors have
    equal ones."""
    for batch in few(batches):
        values = [batch.column(f"values_{s}") for s in "ab"]
        rest = batch.select([n for n in batch.schema.names if not n.startswith("values_")])
        for i, row in enumerate(rest.to_pylist()):
            a, b = (v[i].values.to_numpy(zero_copy_only=False).reshape(len(row[f"ids_{s}"]), -1) for v, s in zip(values, "ab"))
            if a.shape[1] == b.shape[1]:
                yield row, np.einsum("id,jd->ij", a, b)
            else:
                yield row, np.zeros((len(a), len(b)))


def _code(sims: np.ndarray) -> np.ndarray:
    """The cosine as a whole number."""
    top = 1 << (BIN_BITS * PASSES)
    return np.clip(((sims + 1.0) * (top / 2)).astype(np.int64), 0, top - 1)


def _classes(row: dict, wanted: set[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Which pairs of two blocks are in a class."""
    inner = np.ones((len(row["ids_a"]), len(row["ids_b"])), dtype=bool)
    if row["block"] == row["other"]:
        inner = np.triu(inner, 1)
    if ALL in wanted:
        yield ALL, inner
    if wanted != {ALL}:
        a, b = (np.array(row[f"labels_{s}"], dtype=object) for s in "ab")
        same = a[:, None] == b[None, :]
        if SAME in wanted:
            yield SAME, inner & same
        if OTHER in wanted:
            yield OTHER, inner & ~same


def _counted(table: DataFrame, wanted: set[str], level: int) -> DataFrame:
    """(meeting_id, cls, stat, bin, n): pairs per bin. ``table`` has ``open``: (cls, stat, prefix) of the statistics that are
    looked for, empty in the first pass. Counts are added up in a task as long as a meeting goes on."""
    shift = BIN_BITS * (PASSES - 1 - level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        meeting = None

        def given() -> pa.RecordBatch:
            keys = list(held)
            at = [np.flatnonzero(held[k]) for k in keys]
            sizes = [len(x) for x in at]
            columns = [np.repeat(np.array([k[i] for k in keys], dtype=object), sizes).tolist() for i in range(3)]
            bins = np.concatenate(at) if at else np.zeros(0, np.int64)
            n = np.concatenate([held[k][x] for k, x in zip(keys, at)]) if at else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(bins.astype(np.int32)), pa.array(n.astype(np.int64))],
                ["meeting_id", "cls", "stat", "bin", "n"],
            )

        for row, sims in _products(batches):
            if row["meeting_id"] != meeting and held:
                yield given()
            meeting = row["meeting_id"]
            code = _code(sims)
            for cls, mask in _classes(row, wanted):
                seen = code[mask]
                looked = [(0, None)] if level == 0 else [(o["stat"], o["prefix"]) for o in row["open"] if o["cls"] == cls]
                for stat, prefix in looked:
                    some = seen if prefix is None else seen[(seen >> (shift + BIN_BITS)) == prefix]
                    counts = np.bincount((some >> shift) & (BINS - 1), minlength=BINS)
                    key = (meeting, cls, stat)
                    held[key] = counts if key not in held else held[key] + counts
        yield given()

    counted = table.sortWithinPartitions(*KEY).mapInArrow(run, "meeting_id string, cls string, stat int, bin int, n long")
    return counted.groupBy(*KEY, "cls", "stat", "bin").agg(F.sum("n").alias("n"))


def percentiles(vecs: DataFrame, wanted: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(meeting_id, cls, n, pct): for each wanted class of pairs its interpolated percentile of the cosine, where it has pairs."""
    classes = set(wanted)
    pairs = met(blocks(vecs, block))
    share = F.lit(None).cast("double")
    for cls, p in wanted.items():
        share = F.when(F.col("cls") == cls, F.lit(float(p))).otherwise(share)
    keys = [*KEY, "cls", "stat"]
    found: DataFrame | None = None
    for level in range(PASSES):
        if found is None:
            counts = cut_lineage(_counted(pairs, classes, 0)).drop("stat")
            total = counts.groupBy(*KEY, "cls").agg(F.sum("n").alias("total"))
            at = F.col("share") * (F.col("total") - 1)
            stats = total.withColumn("share", share).select(
                *KEY, "cls", "total", (at - F.floor(at)).alias("part"),
                F.explode(F.array(F.struct(F.lit(0).alias("stat"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("stat"), F.ceil(at).alias("rank")))).alias("s"),
            ).select(*KEY, "cls", "total", "part", "s.stat", "s.rank", F.lit(0).cast("long").alias("prefix"))
            ranked = stats.join(counts, [*KEY, "cls"])
        else:
            opened = found.groupBy(*KEY).agg(F.collect_list(F.struct("cls", "stat", "prefix")).alias("open"))
            counts = cut_lineage(_counted(pairs.join(opened, KEY), classes, level))
            ranked = found.join(counts, keys)
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
        ranked = ranked.withColumn("_upto", upto).filter((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank")))
        found = cut_lineage(
            ranked.select(*keys, "total", "part", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), (F.col("prefix") * BINS + F.col("bin")).alias("prefix"))
        )
    value = (F.col("prefix") + 0.5) / F.lit(2.0 ** (BIN_BITS * PASSES - 1)) - 1.0
    sides = [F.max(F.when(F.col("stat") == s, value)) for s in (0, 1)]
    out = found.groupBy(*KEY, "cls").agg(F.max("total").alias("n"), F.max("part").alias("_part"), sides[0].alias("_lo"), sides[1].alias("_hi"))
    return out.select(*KEY, "cls", "n", (F.col("_lo") + F.col("_part") * (F.col("_hi") - F.col("_lo"))).alias("pct"))


def nearest(vecs: DataFrame, p: int, value: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(meeting_id, i, j, v): for each vector its entries, itself with value 1 included, not under its p-th largest; ties are
    kept. A pair of blocks gives at most p entries a row and their ties, from which the row's own are taken."""

    def kept(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if v.shape[1] <= p:
            return np.nonzero(np.ones(v.shape, dtype=bool))
        return np.nonzero(v >= np.partition(v, v.shape[1] - p, axis=1)[:, [v.shape[1] - p]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sims in _products(batches):
            v = value(sims)
            ids = [np.array(row[f"ids_{s}"]) for s in "ab"]
            if row["block"] == row["other"]:
                np.fill_diagonal(v, 1.0)
            for own, other, m in [(0, 1, v)] if row["block"] == row["other"] else [(0, 1, v), (1, 0, v.T)]:
                i, j = kept(m)
                yield pa.RecordBatch.from_arrays([pa.array([row["meeting_id"]] * len(i), pa.string()), pa.array(ids[own][i]), pa.array(ids[other][j]), pa.array(m[i, j])], ["meeting_id", "i", "j", "v"])

    partial = met(blocks(vecs, block)).mapInArrow(run, "meeting_id string, i long, j long, v double")
    rank = F.rank().over(Window.partitionBy(*KEY, "i").orderBy(F.col("v").desc()))
    return partial.withColumn("_r", rank).filter(F.col("_r") <= p).drop("_r")


def reachable(edges: DataFrame) -> DataFrame:
    """(meeting_id, node, root): the smallest node that is reachable over edges (meeting_id, i, j), whatever their direction.

    Every node points to a smaller one or itself. In a round the roots of the two ends of an edge are hooked together, the
    larger to the smallest beside it, and every pointer jumps twice, so trees shrink and rounds grow with the logarithm of the
    longest chain. All meetings go through a round together; a round is written, and ends in one flag.
    """
    both = edges.select(*KEY, F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(*KEY, F.col("j").alias("a"), F.col("i").alias("b")))
    links = cut_lineage(both.filter("a <> b").distinct())
    nodes = edges.select(*KEY, F.explode(F.array("i", "j")).alias("node")).distinct()
    known = cut_lineage(nodes.select(*KEY, "node", F.col("node").alias("root")))
    while True:
        at_a = links.join(known.select(*KEY, F.col("node").alias("a"), F.col("root").alias("root_a")), [*KEY, "a"])
        ends = at_a.join(known.select(*KEY, F.col("node").alias("b"), F.col("root").alias("root_b")), [*KEY, "b"])
        # a node hears the smallest root beside it, and so does the root it points to
        heard = ends.filter("root_b < root_a").select(*KEY, F.explode(F.array("a", "root_a")).alias("node"), F.col("root_b").alias("less"))
        heard = heard.groupBy(*KEY, "node").agg(F.min("less").alias("less"))
        hooked = cut_lineage(known.join(heard, [*KEY, "node"], "left").select(*KEY, "node", F.least("root", F.coalesce("less", "root")).alias("root"), F.col("less").isNotNull().alias("moved")))
        if hooked.filter("moved").isEmpty():
            return known
        known = hooked.drop("moved")
        for _ in range(2):
            ahead = known.select(*KEY, F.col("node").alias("root"), F.col("root").alias("next"))
            known = known.join(ahead, [*KEY, "root"]).select(*KEY, "node", F.col("next").alias("root"))
        known = cut_lineage(known)
