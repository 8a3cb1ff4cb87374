"""Quality scores of documents: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text (lengths, kinds of characters, repetition of words) are standardised and mapped to random
Fourier features, which approximate a Gaussian kernel. Partitions sum the normal equations of the labelled rows; the sums
have a fixed size, so the driver solves them, whatever the number of rows. Raw scores of other labelled rows are counted in
``BINS`` bins and made monotone (pool adjacent violators), which gives a probability. Text is read once; all later steps
work on the statistics, a written table of ``len(NAMES)`` numbers a row.

Defined results: a null text is empty, and an empty text gets the score of its statistics; labels that are null or neither 0
nor 1 are not learnt from, repeated labels count as often as they occur; without any label of a class all scores are
``PRIOR``; a null id is neither learnt from nor held out; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm import columns as C
from palaver.llm.shared import tidy, written
from palaver.llm.textbatch import LOWER, pieces, span_hashes, words

FEATURES, BANDWIDTH, RIDGE, BINS, SEED, PRIOR = 256, 4.0, 1e-3, 2048, 11, 0.5
LOW, HIGH = -0.5, 1.5
NAMES = (
    "bytes", "words", "word_length", "upper", "bang", "bar", "symbol", "digit", "line", "stop", "wide", "other", "distinct",
    "again", "pairs", "top",
)


def _classes() -> np.ndarray:
    """Byte classes as columns: letters, upper, !, |, symbols, digits, line ends, stops, beyond ASCII, other signs."""
    table = np.zeros((256, 10))
    table[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
    table[65:91, 1] = 1
    table[ord("!"), 2] = 1
    table[ord("|"), 3] = 1
    table[[*b"#$%&*@^~"], 4] = 1
    table[48:58, 5] = 1
    table[10, 6] = 1
    table[[*b".,;:?"], 7] = 1
    table[128:, 8] = 1
    table[[*b"\"'()-+/<=>[]_`{}\\"], 9] = 1
    return table


CLASSES = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    out = np.zeros((len(column), len(NAMES)))
    for lo, hi, data, offsets in pieces(column):
        n = hi - lo
        counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) @ CLASSES
        starts, ends, owner = words(data, offsets)
        hashes = span_hashes(LOWER[data], starts, ends)
        size = np.bincount(owner, minlength=n)
        letters = np.bincount(owner, ends - starts, minlength=n)
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
        again = np.bincount(owner[1:][same], minlength=n)
        bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
        variety = np.zeros((n, 3))
        mixed = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1] if len(hashes) > 1 else hashes[:0]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b - a:
                _, c = np.unique(hashes[a:b], return_counts=True)
                pairs = len(np.unique(mixed[a : b - 1])) if b - a > 1 else 1
                variety[i] = len(c), pairs, c.max()
        w, nonempty, alpha = np.maximum(size, 1), np.maximum(np.diff(offsets), 1), np.maximum(counts[:, 0], 1)
        out[lo:hi] = np.column_stack([
            np.log1p(np.diff(offsets)), np.log1p(size), np.log1p(letters / w), counts[:, 1] / alpha,
            *(np.sqrt(counts[:, j] / w) for j in (2, 3, 4, 5, 6, 7)), counts[:, 8] / nonempty, np.sqrt(counts[:, 9] / w),
            variety[:, 0] / w, again / w, variety[:, 1] / w, variety[:, 2] / w,
        ])
    return out


def held_out(id_column: str, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, stats): the only step that reads text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            ends = pa.array(np.arange(len(found) + 1, dtype="i4") * len(NAMES))
            stats = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), stats], [id_column, "stats"])

    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"`{id_column}` {kind}, stats array<double>")


class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((len(mean), FEATURES)) / BANDWIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(stats[i : i + 4096]) @ self.weights for i in range(0, len(stats), 4096)] or [np.zeros(0)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(stats), PRIOR)
        return np.interp(self.raw(stats), *self.curve)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows: each partition adds up its own, the rows of the partitions' sums are added by number."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                z = model.features(_stats(part))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ part.column("y").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="i4")), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(x) for x in table.column("row").to_pylist()], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([rows.tobytes()], pa.binary())})

    parts = train.select("stats", "y").mapInArrow(tidy(run), "i int, row binary")
    found = parts.groupBy("i").applyInArrow(add, "i int, row binary").collect()  # FEATURES + 1 rows of fixed size
    table = np.stack([np.frombuffer(r["row"]) for r in sorted(found, key=lambda r: r["i"])])
    return table[:, :size], table[:, size]


def isotonic(at: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order; the curve goes through the blocks' centres."""
    blocks: list[list[float]] = []
    for x, h, c in zip(at, hits, n):
        blocks.append([x * c, h, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], np.clip(b[:, 1] / b[:, 2], 0, 1)


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", remainder: int = 0) -> Model:
    """Learn from labelled rows that are not held out: one in four of them calibrates, the others fit."""
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("y"))
    fold = F.crc32(F.concat(F.col(id_column).cast("string"), F.lit("calibration")).cast("binary")) % 4
    train = written(
        stats.filter(~held_out(id_column, remainder)).join(marked, F.col(id_column) == F.col("_id")).select("stats", "y", (fold == 0).alias("calibrates")), "labelled"
    )
    aggs = [f for j in range(len(NAMES)) for f in (F.avg(F.col("stats")[j]).alias(f"m{j}"), F.stddev_pop(F.col("stats")[j]).alias(f"s{j}"))]
    r = train.agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), *aggs).first()
    if not r["n"] or r["lo"] == r["hi"]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array([r[f"m{j}"] for j in range(len(NAMES))]), np.maximum([r[f"s{j}"] for j in range(len(NAMES))], 1e-6))
    a, b = normal_equations(train.filter(~F.col("calibrates")), model)
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.diag([*np.ones(FEATURES), 1e-9]) + 1e-9 * np.eye(len(b)), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.clip((model.raw(_stats(batch)) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("y")], ["bin", "y"])

    calibration = train.filter("calibrates").select("stats", "y").mapInArrow(binned, "bin int, y int")
    bins = sorted(calibration.groupBy("bin").agg(F.sum("y").alias("h"), F.count("*").alias("n")).collect())  # at most BINS rows
    if bins:
        at = LOW + (np.array([b["bin"] for b in bins]) + 0.5) * (HIGH - LOW) / BINS
        model.curve = isotonic(at, np.array([b["h"] for b in bins], float), np.array([b["n"] for b in bins], float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` for its statistics."""
    kept = [f for f in stats.schema.fields if f.name not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(model.score(_stats(batch)))], [*(f.name for f in kept), "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return stats.select(*[f.name for f in kept], "stats").mapInArrow(tidy(run), schema)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all columns and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.split(batches, text):
            yield C.extend(batch, {"score": pa.array(model.score(statistics(batch.column(text))))})

    return C.map_batches(docs, run, {"score": "double"})


def scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, score) of every document."""
    stats = written(document_statistics(docs, id_column, text), "statistics")
    return score(stats, fit(stats, labels, id_column, label))
