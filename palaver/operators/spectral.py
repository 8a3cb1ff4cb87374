"""Speakers of each meeting from all of its vectors: spectral clusters, and mixtures for their number.

Both rest on one small matrix per meeting, a sum over its vectors. The affinity (1 + cosine) / 2 of unit vectors is the product
of the rows (1, v) / sqrt(2) with one another, so the leading eigenvectors of a meeting's normalised affinity follow from a
(dim + 1)-wide product matrix: neither edges nor pairs are made. All meetings go through a round together; sums are formed
before the shuffle, and a round is written.

A vector that is not usable (see ``pairs``), or is shorter than the longest usable one of its meeting, has no part in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import vectors
from palaver.operators import pairs
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
COMPONENTS = 8
COVARIANCE_FLOOR, LIKELIHOOD_STEP, CENTRE_STEP = 1e-6, 1e-3, 1e-4
# ----------------------------------------------------------------------------------------------------------------

KEY = ["meeting_id"]
POINTS_IN_BLOCK = 2048
#: Points of a meeting from which the first mixtures are formed; all points refine them.
STARTING_POINTS, STARTS = 1000, 5
LLOYD_ROUNDS, MIXTURE_ROUNDS = 50, 300


def unit_rows(vecs: DataFrame) -> DataFrame:
    """(meeting_id, sub_idx, v): unit vectors, all of one meeting of the same length."""
    rows = pairs.usable_only(vecs).select(*KEY, "sub_idx", vectors.l2_normalize(F.col("embedding"), 0.0).alias("v"))
    longest = rows.groupBy(*KEY).agg(F.max(F.size("v")).alias("_dim"))
    return rows.join(longest, KEY).filter(F.size("v") == F.col("_dim")).drop("_dim")


def vector_sum(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Sum of an array column per meeting."""
    return rows.groupBy(*KEY).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(name), F.count("*").alias("n"))


def products(rows: DataFrame) -> DataFrame:
    """(meeting_id, gram): sum of weight times the outer product of v per meeting; ``rows`` are (meeting_id, v, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, gram = None, None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([meeting], pa.string()), pa.array([gram.ravel().tolist()], pa.list_(pa.float64()))], ["meeting_id", "gram"])

        for batch in batches:
            keys = np.array(batch.column("meeting_id").to_pylist(), dtype=object)
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for a, b in zip(starts, starts[1:]):
                v = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                part = (v * weight[a:b, None]).T @ v
                if keys[a] != meeting and gram is not None:
                    yield given()
                    gram = None
                meeting, gram = keys[a], part if gram is None else gram + part
        if gram is not None:
            yield given()

    partial = rows.select(*KEY, "v", "weight").sortWithinPartitions(*KEY).mapInArrow(run, "meeting_id string, gram array<double>")
    return vector_sum(partial, "gram", "gram").drop("n")


def leading(grams: DataFrame, axes: Callable[[dict], np.ndarray], others: str) -> DataFrame:
    """(meeting_id, axes): the columns that ``axes`` makes of each meeting's row, as a list of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs.few(batches):
            rows = batch.to_pylist()
            found = [axes(r).T.tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["meeting_id"] for r in rows], pa.string()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["meeting_id", "axes"])

    return grams.select(*KEY, "gram", *others.split()).mapInArrow(run, "meeting_id string, axes array<array<double>>")


def _top(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors, whose largest entry is positive."""
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return values, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


# --- spectral clusters ------------------------------------------------------------------------------------------


def spectral_points(vecs: DataFrame, k: int) -> DataFrame:
    """(meeting_id, sub_idx, y): each vector's entries in the min(k, n) leading eigenvectors of its meeting's normalised affinity,
    divided by the root of its degree. Directions without any weight are left out."""
    half = float(np.sqrt(0.5))
    lifted = F.concat(F.array(F.lit(half)), F.transform("v", lambda x: x * half))
    rows = cut_lineage(unit_rows(vecs).select(*KEY, "sub_idx", lifted.alias("v")))
    totals = vector_sum(rows, "v", "total")
    weighed = cut_lineage(rows.join(totals, KEY).select(*KEY, "sub_idx", "v", "n", (1.0 / vectors.dot(F.col("v"), F.col("total"))).alias("weight")))
    sizes = totals.select(*KEY, "n")

    def axes(row: dict) -> np.ndarray:
        dim = int(np.sqrt(len(row["gram"])))
        values, found = _top(np.array(row["gram"]).reshape(dim, dim), min(k, row["n"]))
        kept = values > 1e-12
        return found[:, kept] / np.sqrt(values[kept])

    found = cut_lineage(leading(products(weighed).join(sizes, KEY), axes, "n"))
    met = weighed.join(found, KEY)
    return met.select(*KEY, "sub_idx", F.transform("axes", lambda a: vectors.dot(F.col("v"), a) * F.col("weight")).alias("y"))


def _apart(y: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(y, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def _seeds(points: DataFrame, k: int) -> DataFrame:
    """(meeting_id, centres): up to k different points, each the farthest from those before, the first from the mean."""
    mean = vector_sum(points, "y", "s").select(*KEY, F.array(F.transform("s", lambda x: x / F.col("n"))).alias("centres"))
    seeds, taken = mean, 0
    while taken < k:
        far = F.array_min(F.transform("centres", lambda c: _apart(F.col("y"), c)))
        scored = points.join(seeds, KEY).select(*KEY, "sub_idx", "y", far.alias("d"))
        best = scored.groupBy(*KEY).agg(F.max(F.struct("d", (-F.col("sub_idx")).alias("first"), "y")).alias("b"))
        found = best.filter(F.col("b.d") > 1e-18) if taken else best
        chosen = found.select(*KEY, F.array("b.y").alias("new"))
        grown = seeds.join(chosen, KEY, "left")
        seeds = cut_lineage(grown.select(*KEY, F.concat("centres", F.coalesce("new", F.slice("centres", 1, 0))).alias("centres") if taken else F.col("new").alias("centres")))
        taken += 1
    return seeds


def nearest_centres(points: DataFrame, k: int, rounds: int = LLOYD_ROUNDS) -> DataFrame:
    """(meeting_id, sub_idx, label): clusters of at most k per meeting around their means; a cluster that loses all its points
    keeps its place. Ends when no centre of a meeting moves by more than ``CENTRE_STEP`` of its points' variance per coordinate."""
    spread = points.groupBy(*KEY).agg(*[F.var_pop(F.get("y", F.lit(i))).alias(f"_{i}") for i in range(k)])
    known = [F.coalesce(f"_{i}", F.lit(0.0)) for i in range(k)]
    limit = spread.select(*KEY, (sum(known[1:], known[0]) * (CENTRE_STEP / k)).alias("limit"))
    centres = cut_lineage(_seeds(points, k).join(limit, KEY))

    def labelled(at: DataFrame) -> DataFrame:
        each = F.transform("centres", lambda c, i: F.struct(_apart(F.col("y"), c).alias("d"), i.alias("label")))
        return points.join(at, KEY).select(*KEY, "sub_idx", "y", F.array_min(each)["label"].alias("label"))

    for _ in range(rounds):
        mean = labelled(centres).groupBy(*KEY, "label").agg(vector_to_array(Summarizer.mean(array_to_vector("y"))).alias("mean"))
        packed = mean.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("m"))
        new = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("m", i), c))
        moved = F.array_max(F.transform(F.arrays_zip(F.col("new").alias("a"), F.col("centres").alias("b")), lambda p: _apart(p["a"], p["b"])))
        step = cut_lineage(centres.join(packed, KEY).withColumn("new", new).select(*KEY, "limit", F.col("new").alias("centres"), moved.alias("moved")))
        centres = step.drop("moved")
        if step.filter("moved > limit").isEmpty():
            break
    return labelled(centres).drop("y")


def cluster_affinity(vecs: DataFrame, k: int) -> DataFrame:
    """(meeting_id, sub_idx, label): at most k spectral clusters of every meeting by the affinity (1 + cosine) / 2 of its vectors.

    Labels go from 0 in the order of first appearance. With k = 1, or one vector, all are 0. A vector without part has a null label.
    """
    points = cut_lineage(spectral_points(vecs, k))
    found = cut_lineage(nearest_centres(points, k))
    first = found.groupBy(*KEY, "label").agg(F.min("sub_idx").alias("_first"))
    names = first.withColumn("_new", F.row_number().over(Window.partitionBy(*KEY).orderBy("_first")) - 1)
    named = found.join(names, [*KEY, "label"]).select(*KEY, "sub_idx", F.col("_new").alias("label"))
    return vecs.select(*KEY, "sub_idx").join(named, [*KEY, "sub_idx"], "left")


# --- number of speakers -----------------------------------------------------------------------------------------


class Mixture:
    """Gaussian mixture of k components with full covariances, from sums over points."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> None:
        self.weights, self.means, self.covs = weights, means, covs

    @classmethod
    def of_sums(cls, sums: np.ndarray, k: int, dims: int) -> Mixture:
        """``sums`` holds, per component, the share of points, of points times coordinates and of their products."""
        s = sums.reshape(k, 1 + dims + dims * dims)
        n = s[:, 0] + 10 * np.finfo(float).eps
        means = s[:, 1 : 1 + dims] / n[:, None]
        covs = s[:, 1 + dims :].reshape(k, dims, dims) / n[:, None, None] - means[:, :, None] * means[:, None, :]
        covs = (covs + covs.transpose(0, 2, 1)) / 2 + COVARIANCE_FLOOR * np.eye(dims)
        return cls(n / n.sum(), means, covs)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each point's share in each component, and the log likelihood of all points."""
        logs = np.empty((len(x), len(self.weights)))
        for c, (w, m, cov) in enumerate(zip(self.weights, self.means, self.covs)):
            values, axes = np.linalg.eigh(cov)
            values = np.maximum(values, COVARIANCE_FLOOR / 2)
            z = ((x - m) @ axes) / np.sqrt(values)
            logs[:, c] = np.log(max(w, 1e-300)) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(values).sum() + (z * z).sum(axis=1))
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - total[:, None]), float(total.sum())

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        shares, likelihood = self.shares(x)
        return sums_of(x, shares), likelihood

    def flat(self) -> list[float]:
        return np.concatenate([self.weights, self.means.ravel(), self.covs.ravel()]).tolist()

    @classmethod
    def of_flat(cls, flat: np.ndarray, k: int, dims: int) -> Mixture:
        return cls(flat[:k], flat[k : k + k * dims].reshape(k, dims), flat[k + k * dims :].reshape(k, dims, dims))


def sums_of(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return np.column_stack([shares.sum(axis=0), shares.T @ x, shares.T @ outer]).ravel()


def _started(x: np.ndarray, k: int, seed: int) -> Mixture:
    """The best of ``STARTS`` mixtures, each begun at spread points and refined until the likelihood stands."""
    best, best_likelihood = None, -np.inf
    for start in range(STARTS if k > 1 else 1):
        rng = np.random.default_rng([seed, k, start])
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            at = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[at]])
        for _ in range(20):
            label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.stack([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
            if np.array_equal(moved, centres):
                break
            centres = moved
        mixture = Mixture.of_sums(sums_of(x, np.eye(k)[label]), k, x.shape[1])
        before = -np.inf
        for _ in range(MIXTURE_ROUNDS):
            sums, likelihood = mixture.sums(x)
            if abs(likelihood - before) < LIKELIHOOD_STEP * len(x):
                break
            before, mixture = likelihood, Mixture.of_sums(sums, k, x.shape[1])
        if likelihood > best_likelihood:
            best, best_likelihood = mixture, likelihood
    return best


def principal_points(vecs: DataFrame, dims: int = COMPONENTS) -> DataFrame:
    """(meeting_id, sub_idx, n, y): unit vectors on the first principal axes of their meeting, at most ``dims`` and n - 1."""
    rows = cut_lineage(unit_rows(vecs).withColumn("weight", F.lit(1.0)))
    totals = vector_sum(rows, "v", "total")

    def axes(row: dict) -> np.ndarray:
        mean = np.array(row["total"]) / row["n"]
        cov = np.array(row["gram"]).reshape(len(mean), -1) / row["n"] - np.outer(mean, mean)
        found = _top(cov, max(1, min(dims, row["n"] - 1, len(mean))))[1]
        return np.vstack([found, mean @ found])  # the last entry is the place of the mean

    found = cut_lineage(leading(products(rows).join(totals, KEY), axes, "n total"))
    met = rows.join(found, KEY).join(totals.select(*KEY, "n"), KEY)
    at = F.transform("axes", lambda a: vectors.dot(F.col("v"), F.slice(a, 1, F.size("v"))) - F.element_at(a, -1))
    return met.select(*KEY, "sub_idx", "n", at.alias("y"))


def _first_mixtures(points: DataFrame, min_k: int, max_k: int, seed: int) -> DataFrame:
    """(meeting_id, k, dims, n, params) from the meeting's points of smallest hash, at most ``STARTING_POINTS``."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.xxhash64("sub_idx"), "sub_idx"))
    some = points.withColumn("_r", rank).filter(F.col("_r") <= STARTING_POINTS).groupBy(*KEY).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("sub_idx", "y"))).alias("p"))
    per_k = some.select(*KEY, "n", F.transform("p", lambda p: p["y"]).alias("p"), F.explode(F.sequence(F.lit(min_k), F.greatest(F.lit(min_k), F.least(F.lit(max_k), F.floor(F.col("n") / 2).cast("int"))))).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs.few(batches):
            for r in batch.to_pylist():
                x = np.array(r["p"])
                params = _started(x, r["k"], seed).flat()
                arrays = [pa.array([r["meeting_id"]], pa.string()), pa.array([r["k"]], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([r["n"]], pa.int64()), pa.array([params], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["meeting_id", "k", "dims", "n", "params"])

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # long work on few bytes: not to be coalesced
    return per_k.repartition(tasks, *KEY, "k").mapInArrow(run, "meeting_id string, k int, dims int, n long, params array<double>")


def _expected(met: DataFrame) -> DataFrame:
    """(meeting_id, k, sums): what a block of points adds to each mixture; the log likelihood is the last entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                meeting, k, dims = (row.column(c)[0].as_py() for c in ("meeting_id", "k", "dims"))
                x = row.column("points").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                sums, likelihood = Mixture.of_flat(row.column("params").flatten().to_numpy(zero_copy_only=False), k, dims).sums(x)
                arrays = [pa.array([meeting], pa.string()), pa.array([k], pa.int32()), pa.array([np.append(sums, likelihood)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["meeting_id", "k", "sums"])

    return met.select(*KEY, "k", "dims", "params", "points").mapInArrow(run, "meeting_id string, k int, sums array<double>")


def _maximised(rows: DataFrame) -> DataFrame:
    """The mixtures of the summed rows, with the likelihood of those that made the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs.few(batches):
            rows = batch.to_pylist()
            new = [Mixture.of_sums(np.array(r["sums"][:-1]), r["k"], r["dims"]).flat() for r in rows]
            likelihood = [r["sums"][-1] for r in rows]
            names = ["meeting_id", "k", "dims", "n"]
            kept = [batch.column(c) for c in names]
            stands = [b is not None and abs(x - b) < LIKELIHOOD_STEP * r["n"] for x, b, r in zip(likelihood, (r["likelihood"] for r in rows), rows)]
            arrays = [*kept, pa.array(new, pa.list_(pa.float64())), pa.array(likelihood, pa.float64()), pa.array(stands, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "params", "likelihood", "done"])

    return rows.mapInArrow(run, "meeting_id string, k int, dims int, n long, params array<double>, likelihood double, done boolean")


def mixtures(points: DataFrame, min_k: int, max_k: int, seed: int, rounds: int = MIXTURE_ROUNDS) -> DataFrame:
    """(meeting_id, k, dims, n, likelihood) of a Gaussian mixture for each meeting and each k, by expectation maximisation over
    blocks of its points; at most half as many components as points. Mixtures whose likelihood stands leave the rounds."""
    packed = points.groupBy(*KEY, F.floor(F.col("sub_idx") / POINTS_IN_BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("sub_idx", "y"))).alias("p"))
    blocks = cut_lineage(packed.select(*KEY, F.flatten(F.transform("p", lambda p: p["y"])).alias("points")))
    active = cut_lineage(_first_mixtures(points, min_k, max_k, seed).withColumn("likelihood", F.lit(None).cast("double")))
    done: DataFrame | None = None
    for left in range(rounds, 0, -1):
        parts = _expected(blocks.join(active, KEY)).groupBy(*KEY, "k").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        step = cut_lineage(_maximised(active.select(*KEY, "k", "dims", "n", "likelihood").join(parts, [*KEY, "k"])))
        ended = step.filter("done") if left > 1 else step
        done = ended if done is None else done.unionByName(ended)
        active = step.filter("NOT done").drop("done")
        if active.isEmpty():
            break
    return done.select(*KEY, "k", "dims", "n", "likelihood")


def cluster_count_bic(vecs: DataFrame, one_speaker: DataFrame, min_k: int = 1, max_k: int = 20, dims: int = COMPONENTS, seed: int = 42) -> DataFrame:
    """(meeting_id, k, bic, best): BIC of the mixtures of each meeting over k; the lowest, with the smallest k on a tie, is ``best``.

    Fewer than four vectors, or a meeting with ``single`` in ``one_speaker`` if one speaker is allowed, decide without a mixture:
    one row without BIC and the least k. There are at most half as many speakers as vectors, but the least k is always tried.
    """
    least = max(1, min_k)
    counted = vecs.groupBy(*KEY).agg(F.count_if(pairs.usable(F.col("embedding"))).alias("n"))
    known = counted.join(one_speaker.select(*KEY, "single"), KEY, "left")
    single = F.coalesce("single", F.lit(False)) if min_k <= 1 else F.lit(False)
    known = cut_lineage(known.select(*KEY, ((F.col("n") < 4) | single).alias("decided")))
    rest = vecs.join(known.filter("NOT decided"), KEY, "left_semi")
    points = cut_lineage(principal_points(rest, dims))
    fitted = mixtures(points, least, max(least, max_k), seed)
    k, d = F.col("k"), F.col("dims")
    free = k * d + k * d * (d + 1) / 2 + k - 1
    scored = fitted.select(*KEY, "k", (-2.0 * F.col("likelihood") + free * F.log(F.col("n").cast("double"))).alias("bic"))
    order = Window.partitionBy(*KEY).orderBy("bic", "k")
    ranked = scored.withColumn("best", F.row_number().over(order) == 1)
    return ranked.unionByName(known.filter("decided").select(*KEY, F.lit(least).alias("k"), F.lit(None).cast("double").alias("bic"), F.lit(True).alias("best")))
