"""Speaker vectors: centroids, thresholds, quality, affinity graphs and keyed online clustering.

Sums over all pairs of a meeting are written through label sums: for unit vectors the mean cosine from a vector to a
cluster is its dot product with the cluster's mean, so silhouettes and degrees need no pair table. What does need single
pairs (order statistics, nearest neighbours, blurring) compares all vectors of a meeting, in pairs of blocks that are dealt
to tasks. Only the live clustering begins with the first ``BOOTSTRAP_SIZE`` vectors of a meeting and assigns later ones to
the nearest centroid.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import vectors
from palaver.operators import pairs
from palaver.plans.scans import block_pass
from palaver.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------------------------
BOOTSTRAP_SIZE = 1000
PAIR_BLOCK = 64
DEFAULT_THRESHOLD, MIN_THRESHOLD, MAX_THRESHOLD = 0.6, 0.3, 0.85
SINGLE_SPEAKER_MEDIAN = 0.75
ROW_PERCENTILE, ROW_FACTOR = 0.95, 0.01
# ----------------------------------------------------------------------------------------------------------------

KEY = ["meeting_id"]


def embedding_stats(vecs: DataFrame) -> DataFrame:
    return vecs.groupBy(*KEY).agg(
        F.count("embedding").alias("n_vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    )


def speaker_count(vecs: DataFrame) -> DataFrame:
    return vecs.groupBy(*KEY).agg(F.countDistinct("label").alias("n_speakers"))


def bootstrap(vecs: DataFrame, size: int = BOOTSTRAP_SIZE) -> DataFrame:
    """The first vectors of each meeting, by index."""
    return vecs.filter(F.col("sub_idx") < size)


def means(vecs: DataFrame, by: list[str]) -> DataFrame:
    """Mean vector and size per group, of usable vectors; partial sums are formed before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    return pairs.usable_only(vecs).groupBy(*by).agg(vector_to_array(mean).alias("mean"), F.count("*").alias("n"))


def centroids(vecs: DataFrame, normalized: bool = True, eps: float = 1e-9) -> DataFrame:
    """Mean vector per label, scaled to unit length, and its size."""
    rows = vecs.withColumn("embedding", vectors.l2_normalize(F.col("embedding"), 0.0)) if normalized else vecs
    return means(rows, [*KEY, "label"]).select(*KEY, "label", vectors.l2_normalize(F.col("mean"), eps).alias("centroid"), "n")


def nearest_centroid(vecs: DataFrame, cents: DataFrame) -> DataFrame:
    """Label and similarity of the closest centroid of the meeting, the lowest label on a tie.

    Centroids are few per meeting and travel as one small array, so no vector is copied per centroid. A vector that is not
    usable has neither label nor similarity.
    """
    packed = cents.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))
    joined = vecs.drop("label").join(packed, KEY)
    scored = F.transform(
        "_c",
        lambda c: F.struct(vectors.dot(F.col("embedding"), c["centroid"]).alias("sim"), (-c["label"]).alias("neg")),
    )
    best = F.when(pairs.usable(F.col("embedding")), F.array_max(scored))
    return joined.withColumn("_best", best).withColumns(
        {"label": -F.col("_best.neg"), "sim": F.col("_best.sim")}
    ).drop("_c", "_best")


def relabel_contiguous(rows: DataFrame) -> DataFrame:
    """Labels of each meeting renumbered 0..k-1 in label order, from the distinct labels only."""
    names = rows.select(*KEY, "label").distinct()
    ranked = names.withColumn("_new", F.row_number().over(Window.partitionBy(*KEY).orderBy("label")) - 1)
    return rows.join(ranked, [*KEY, "label"]).withColumn("label", F.col("_new")).drop("_new")


def merge_small_clusters(vecs: DataFrame, min_size: int) -> DataFrame:
    """Vectors of clusters under ``min_size`` go to the nearest larger cluster; meetings without one stay."""
    cents = means(vecs, [*KEY, "label"]).withColumn("_large", F.col("n") >= min_size)
    large = cents.filter("_large").select(*KEY, "label", vectors.l2_normalize(F.col("mean")).alias("centroid"))
    sizes = cents.select(*KEY, "label", "_large")
    has = large.select(*KEY).distinct().withColumn("_any", F.lit(True))
    tagged = vecs.join(sizes, [*KEY, "label"]).join(has, KEY, "left")
    moving = F.col("_any").isNotNull() & ~F.col("_large")
    unit = tagged.filter(moving).withColumn("embedding", vectors.l2_normalize(F.col("embedding")))
    moved = nearest_centroid(unit, large).select(*KEY, "sub_idx", F.col("label").cast("int").alias("label"))
    stay = tagged.filter(~moving).select(*KEY, "sub_idx", "label")
    return relabel_contiguous(stay.unionByName(moved))


def _closest_pairs(cents: DataFrame) -> DataFrame:
    """Closest two label means of each meeting by cosine distance (meeting_id, a, b, d), lowest labels on a tie."""
    packed = cents.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("c"))
    one = packed.select(*KEY, "c", F.explode("c").alias("x"))
    rest = F.filter("c", lambda y: y["label"] > F.col("x.label"))
    scored = F.transform(
        rest,
        lambda y: F.struct(
            (1.0 - vectors.cosine(F.col("x.mean"), y["mean"])).alias("d"), F.col("x.label").alias("a"), y["label"].alias("b")
        ),
    )
    best = one.select(*KEY, F.array_min(scored).alias("m")).filter("m IS NOT NULL")
    return best.groupBy(*KEY).agg(F.min("m").alias("m")).select(*KEY, "m.*")


def _weighted(cents: DataFrame) -> DataFrame:
    """Means merged by label, weighted by size."""
    dims = cents.select(*KEY, "label", "n", F.posexplode("mean").alias("dim", "x"))
    merged = dims.groupBy(*KEY, "label", "dim").agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("x"))
    sizes = cents.groupBy(*KEY, "label").agg(F.sum("n").alias("n"))
    packed = merged.groupBy(*KEY, "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("mean")
    )
    return packed.join(sizes, [*KEY, "label"])


def merge_close_centroids(vecs: DataFrame, threshold: float, rounds: int | None = None) -> DataFrame:
    """Merge the two closest label means of every meeting while their distance is at most ``threshold``.

    Vectors are read once, to form the label means. The rounds work on those: each merges one pair per meeting and keeps
    the old-to-new label map; at the end the map is joined to the vectors.
    """
    base = cut_lineage(means(vecs, [*KEY, "label"]))
    current = base
    names = base.select(*KEY, F.col("label").alias("old"), "label")
    done = 0
    while rounds is None or done < rounds:
        pair = cut_lineage(_closest_pairs(current).filter(F.col("d") <= threshold).select(*KEY, "a", "b"))
        if pair.isEmpty():
            break
        to_a = F.when(F.col("label") == F.col("b"), F.col("a")).otherwise(F.col("label"))
        current = cut_lineage(_weighted(current.join(pair, KEY, "left").withColumn("label", F.coalesce(to_a, "label")).drop("a", "b")))
        names = cut_lineage(names.join(pair, KEY, "left").withColumn("label", F.coalesce(to_a, "label")).drop("a", "b"))
        done += 1
    mapped = vecs.withColumnRenamed("label", "old").join(names, [*KEY, "old"]).drop("old")
    return relabel_contiguous(mapped)


def silhouette(vecs: DataFrame) -> DataFrame:
    """Mean cosine silhouette per meeting, of usable vectors; NULL with fewer than two clusters or too few points.

    The distance is (1 - cos) / 2, so the mean distance from a vector to a cluster is (1 - v.mean) / 2 over the unit
    vectors of that cluster; inside the own cluster the vector itself is taken out.
    """
    unit = pairs.usable_only(vecs).withColumn("embedding", vectors.l2_normalize(F.col("embedding"), 0.0))
    cents = cut_lineage(means(unit, [*KEY, "label"]))
    packed = cents.groupBy(*KEY).agg(F.collect_list(F.struct("label", "mean", "n")).alias("_c"), F.sum("n").alias("_total"))
    joined = unit.join(packed, KEY)
    v, own_label = F.col("embedding"), F.col("label")

    def away(c: Column) -> Column:
        return (1.0 - vectors.dot(v, c["mean"])) / 2.0

    others = F.filter("_c", lambda c: c["label"] != own_label)
    own = F.get(F.filter("_c", lambda c: c["label"] == own_label), F.lit(0))
    self_sim = vectors.dot(v, v)
    inner = (1.0 - F.try_divide(vectors.dot(v, own["mean"]) * own["n"] - self_sim, own["n"] - 1)) / 2.0
    scored = joined.withColumns({"_a": inner, "_b": F.array_min(F.transform(others, away)), "_size": own["n"]})
    score = F.when(F.col("_size") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    agg = scored.groupBy(*KEY).agg(F.avg(score).alias("s"), F.any_value(F.size("_c")).alias("k"), F.count("*").alias("n"))
    return agg.select(*KEY, F.when((F.col("k") >= 2) & (F.col("n") >= F.col("k") + 1), F.col("s")).alias("silhouette"))


def silhouette_refine(vecs: DataFrame, steps: int = 2) -> DataFrame:
    """Labels at k, k-1 and k-2 clusters by merging closest means; the best silhouette wins, the first on a tie."""
    current, versions = vecs, []
    for step in range(steps + 1):
        if step:
            current = cut_lineage(merge_close_centroids(current, threshold=float("inf"), rounds=1))
        versions.append((step, current, silhouette(current)))
    scores = None
    for step, _, score in versions:
        tagged = score.withColumn("step", F.lit(step))
        scores = tagged if scores is None else scores.unionByName(tagged)
    # at least three clusters are needed to start, and two must remain
    k = vecs.groupBy(*KEY).agg(F.countDistinct("label").alias("k"))
    open_to = scores.join(k, KEY).filter((F.col("step") == 0) | ((F.col("k") >= 3) & (F.col("k") - F.col("step") >= 2)))
    order = F.struct((-F.coalesce("silhouette", F.lit(-2.0))).alias("s"), "step")
    best = cut_lineage(open_to.groupBy(*KEY).agg(F.min_by("step", order).alias("step")))
    out = None
    for step, rows, _ in versions:
        kept = rows.join(best.filter(F.col("step") == step), KEY, "left_semi").select(*KEY, "sub_idx", "label")
        out = kept if out is None else out.unionByName(kept)
    return out


# --- pairs among bootstrap vectors ------------------------------------------------------------------------------


def pairwise(vecs: DataFrame) -> DataFrame:
    """Cosine of each pair i < j among the vectors of a meeting, with a same-label flag.

    Each vector goes to every block from its own on, so a task holds one block of others and a long meeting is spread.
    """
    own = F.floor(F.col("sub_idx") / PAIR_BLOCK)
    vecs = pairs.usable_only(vecs)
    rows = vecs.select(*KEY, "sub_idx", "label", vectors.l2_normalize(F.col("embedding"), 0.0).alias("v"))
    blocks = rows.groupBy(*KEY, own.alias("_block")).agg(
        F.collect_list(F.struct(F.col("sub_idx").alias("j"), F.col("label").alias("lj"), F.col("v").alias("w"))).alias("_others")
    )
    last = vecs.groupBy(*KEY).agg(F.max(own).alias("_last"))
    sent = rows.join(last, KEY).select(*KEY, "sub_idx", "label", "v", F.explode(F.sequence(own, "_last")).alias("_block"))
    met = sent.join(blocks, [*KEY, "_block"])
    return met.select(*KEY, F.col("sub_idx").alias("i"), "label", "v", F.explode("_others").alias("o")).filter(
        F.col("o.j") > F.col("i")
    ).select(
        *KEY, "i", F.col("o.j").alias("j"), vectors.dot(F.col("v"), F.col("o.w")).alias("sim"),
        (F.col("label") == F.col("o.lj")).alias("same"),
    )


def pair_percentile(vecs: DataFrame, p: float) -> DataFrame:
    """(meeting_id, n, pct): number of pairs and interpolated percentile of their distances."""
    near = pairs.percentiles(vecs, {pairs.ALL: 1.0 - p})
    return near.select(*KEY, "n", (1.0 - F.col("pct")).alias("pct"))


def single_speaker(vecs: DataFrame) -> DataFrame:
    """Whether the median pair similarity says one speaker."""
    median = pairs.percentiles(vecs, {pairs.ALL: 0.5})
    return median.select(*KEY, F.col("pct").alias("median_sim"), (F.col("pct") >= SINGLE_SPEAKER_MEDIAN).alias("single"))


def calibrate_threshold(vecs: DataFrame) -> DataFrame:
    """Midpoint of the 10th percentile within labels and the 90th across, kept in bounds; a default when one is
    missing or a meeting has fewer than four usable vectors."""
    found = pairs.percentiles(vecs, {pairs.SAME: 0.1, pairs.OTHER: 0.9})
    sides = [F.max(F.when(F.col("cls") == c, F.col("pct"))).alias(n) for c, n in ((pairs.SAME, "lo"), (pairs.OTHER, "hi"))]
    meetings = vecs.groupBy(*KEY).agg(F.count_if(pairs.usable(F.col("embedding"))).alias("n_vectors"))
    out = meetings.join(found.groupBy(*KEY).agg(*sides), KEY, "left")
    mid = F.greatest(F.lit(MIN_THRESHOLD), F.least(F.lit(MAX_THRESHOLD), (F.col("lo") + F.col("hi")) / 2.0))
    known = (F.col("n_vectors") >= 4) & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return out.select(*KEY, F.when(known, mid).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


# --- affinity as an edge table (meeting_id, i, j, v) ------------------------------------------------------------


def affinity_edges(vecs: DataFrame, shifted: bool = True) -> DataFrame:
    """Full affinity matrix of a meeting's usable vectors; 1 on the diagonal."""
    vecs = pairs.usable_only(vecs)
    dense = pairwise(vecs)
    value = F.greatest((F.col("sim") + 1.0) / 2.0, F.lit(0.0)) if shifted else F.col("sim")
    upper = dense.select(*KEY, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), value.alias("v"))
    diagonal = vecs.select(*KEY, F.col("sub_idx").alias("i"), F.col("sub_idx").alias("j"), F.lit(1.0).alias("v"))
    return upper.select(*KEY, "e.i", "e.j", "v").unionByName(diagonal)


def knn_graph(vecs: DataFrame, p: int) -> DataFrame:
    """Per vector the affinities at least as large as its p-th largest, its own 1 included, value 1, transposed. Lists of at
    most p entries and ties are kept per pair of blocks; the matrix is never a table."""
    kept = pairs.nearest(vecs, p, lambda sims: np.maximum((sims + 1.0) / 2.0, 0.0))
    return kept.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("v"))


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetrize_mean(edges: DataFrame) -> DataFrame:
    return edges.unionByName(_swapped(edges)).groupBy(*KEY, "i", "j").agg((F.sum("v") / 2.0).alias("v"))


def symmetrize_max(edges: DataFrame) -> DataFrame:
    return edges.unionByName(_swapped(edges)).groupBy(*KEY, "i", "j").agg(F.max("v").alias("v"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.filter("i <> j").groupBy(*KEY, "i").agg(F.sum(F.abs("v")).alias("degree"))


def affinity_degree(vecs: DataFrame) -> DataFrame:
    """Row sums of the cosine matrix without the diagonal, for any number of vectors: v . (sum of all) - v . v."""
    unit = pairs.usable_only(vecs).withColumn("embedding", vectors.l2_normalize(F.col("embedding"), 0.0))
    total = means(unit, KEY)
    joined = unit.join(total, KEY)
    v = F.col("embedding")
    return joined.select(*KEY, "sub_idx", (vectors.dot(v, F.col("mean")) * F.col("n") - vectors.dot(v, v)).alias("degree"))


def connected(edges: DataFrame) -> DataFrame:
    """Whether all nodes of a meeting's symmetric graph hang together; rounds grow with the logarithm of its longest chain."""
    roots = pairs.reachable(edges.filter("v > 0"))
    nodes = edges.select(*KEY, F.explode(F.array("i", "j")).alias("node")).distinct()
    found = nodes.join(roots, [*KEY, "node"], "left").groupBy(*KEY).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("root").alias("n"), F.count("*").alias("all"))
    return found.select(*KEY, (((F.col("n") == F.col("all")) & (F.col("lo") == F.col("hi"))) | (F.col("all") == 1)).alias("connected"))


def diag_fill(edges: DataFrame) -> DataFrame:
    """Diagonal replaced by the largest other entry of its row, at least 0."""
    top = F.max(F.when(F.col("i") != F.col("j"), F.col("v"))).over(Window.partitionBy(*KEY, "i"))
    return edges.withColumn("v", F.when(F.col("i") == F.col("j"), F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(0.0))).otherwise(F.col("v")))


def blur(edges: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Separable Gaussian over rows and columns, mirrored at the edges. Rows of a matrix are arrays of bounded size."""
    from palaver.operators.topics import gaussian_weights

    weights = gaussian_weights(sigma)
    radius = len(weights) // 2

    def pass_over(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy(*KEY, "i").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("vals")
        )
        n = F.size("vals")

        def smooth(_: Column, at: Column) -> Column:
            total = F.lit(0.0)
            for k, w in zip(range(-radius, radius + 1), weights):
                j = F.pmod(at + k, 2 * n)
                total = total + F.lit(w) * F.get("vals", F.least(j, 2 * n - 1 - j))
            return total

        out = packed.select(*KEY, "i", F.posexplode(F.transform("vals", smooth)).alias("j", "v"))
        return out.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "v")

    return pass_over(pass_over(edges))


def row_threshold(edges: DataFrame, p: float = ROW_PERCENTILE, factor: float = ROW_FACTOR) -> DataFrame:
    """Entries under the row's percentile are scaled down; a row has one entry for each vector of the meeting."""
    limit = F.percentile("v", p).over(Window.partitionBy(*KEY, "i"))
    return edges.withColumn("_p", limit).withColumn(
        "v", F.when(F.col("v") < F.col("_p"), F.col("v") * F.lit(factor)).otherwise(F.col("v"))
    ).drop("_p")


def diffuse(edges: DataFrame) -> DataFrame:
    """A times its transpose: rows are packed as arrays and multiplied, one row of the product at a time."""
    rows = edges.groupBy(*KEY, "i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("r")
    )
    blocks = rows.groupBy(*KEY, F.floor(F.col("i") / 64).alias("_block")).agg(
        F.collect_list(F.struct(F.col("i").alias("k"), "r")).alias("_rows")
    )
    met = rows.join(blocks, KEY).select(*KEY, "i", F.col("r").alias("a"), F.explode("_rows").alias("o"))
    return met.select(*KEY, "i", F.col("o.k").alias("j"), vectors.dot(F.col("a"), F.col("o.r")).alias("v"))


def row_max_norm(edges: DataFrame) -> DataFrame:
    top = F.max("v").over(Window.partitionBy(*KEY, "i"))
    return edges.withColumn("_m", top).withColumn(
        "v", F.col("v") / F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.col("_m"))
    ).drop("_m")


def enhance(edges: DataFrame) -> DataFrame:
    """The refinement chain of an affinity matrix."""
    out = cut_lineage(row_threshold(blur(diag_fill(edges))))
    out = cut_lineage(diffuse(symmetrize_max(out)))
    return symmetrize_max(cut_lineage(row_max_norm(out)))


# --- keyed sequential clustering --------------------------------------------------------------------------------


PRODUCT_ROWS = 256


class SpeakerSums:
    """Sum and count of the vectors of at most ``max_speakers`` speakers. Takes (sub_idx, embedding); gives (sub_idx, label).

    The cosine to a mean is the cosine to the sum. The products of a block's vectors with the sums and with one another are
    made at once; putting a vector to a speaker then adds its column of products to that speaker's.
    """

    def __init__(self, threshold: float, max_speakers: int) -> None:
        self.threshold, self.max_speakers = threshold, max_speakers
        self.sums: np.ndarray | None = None
        self.count, self.used = np.zeros(max_speakers), 0

    def feed(self, rows: dict) -> list[tuple]:
        vecs = np.stack([np.asarray(v, dtype=np.float64) for v in rows["embedding"]])
        if self.sums is None:
            self.sums = np.zeros((self.max_speakers, vecs.shape[1]))
        labels = np.concatenate([self._block(vecs[a : a + PRODUCT_ROWS]) for a in range(0, len(vecs), PRODUCT_ROWS)])
        return list(zip(rows["sub_idx"].tolist(), labels.tolist()))

    def _block(self, vecs: np.ndarray) -> np.ndarray:
        gram, dots = vecs @ vecs.T, vecs @ self.sums.T
        norm, square = np.sqrt(gram.diagonal()), (self.sums**2).sum(axis=1)
        labels = np.zeros(len(vecs), dtype=int)
        for i in range(len(vecs)):
            k = self.used
            cosine = dots[i, :k] / (norm[i] * np.sqrt(square[:k]) + 1e-10 * self.count[:k])
            join = k > 0 and (k == self.max_speakers or cosine.max() >= self.threshold)
            at = int(cosine.argmax()) if join else k
            self.used, labels[i] = max(k, at + 1), at
            square[at] += 2 * dots[i, at] + gram[i, i]
            dots[:, at] += gram[:, i]
            self.count[at] += 1
        np.add.at(self.sums, labels, vecs)
        return labels

    def close(self) -> list[tuple]:
        return []


def cosine_greedy(vecs: DataFrame, threshold: float = 0.5, max_speakers: int = 20) -> DataFrame:
    """In index order, join the closest running mean or open a new one; one small state per meeting."""
    return block_pass(
        vecs, KEY, ["sub_idx"], ["sub_idx", "embedding"], lambda: SpeakerSums(threshold, max_speakers),
        "meeting_id string, sub_idx int, label int",
    )


class MovingCentroids:
    """Centroids of one meeting, which the first row brings as ``cents``. Takes (sub_idx, embedding, cents, threshold); gives
    (sub_idx, label).

    As with the sums, products are made once per block; a centroid that moves takes a combination of its own column and the
    vector's. ``create`` opens a label for a vector that is close to none.
    """

    def __init__(self, create: bool) -> None:
        self.create, self.labels = create, []
        self.cents, self.count = np.zeros((0, 0)), np.zeros(0)

    def feed(self, rows: dict) -> list[tuple]:
        if not self.labels:
            brought = rows["cents"][0]
            self.labels = [int(c["label"]) for c in brought]
            self.cents = np.stack([np.asarray(c["centroid"], dtype=np.float64) for c in brought])
            self.count = np.array([float(c["n"]) for c in brought])
        vecs = np.stack([np.asarray(v, dtype=np.float64) for v in rows["embedding"]])
        vecs /= np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-9
        limit, out = float(rows["threshold"][0]), []
        for a in range(0, len(vecs), PRODUCT_ROWS):
            out += self._block(vecs[a : a + PRODUCT_ROWS], limit)
        return list(zip(rows["sub_idx"].tolist(), out))

    def _block(self, vecs: np.ndarray, limit: float) -> list[int]:
        gram, dots, out = vecs @ vecs.T, vecs @ self.cents.T, []
        for i in range(len(vecs)):
            at = int(dots[i].argmax())
            if dots[i, at] >= limit:
                n = self.count[at]
                moved = n * self.cents[at] + vecs[i]
                scale = 1.0 / (np.linalg.norm(moved) + (n + 1) * 1e-9)
                self.cents[at], self.count[at] = moved * scale, n + 1
                dots[:, at] = (n * dots[:, at] + gram[:, i]) * scale
            elif self.create:
                at = len(self.labels)
                self.labels.append(max(self.labels) + 1)
                self.cents, self.count = np.vstack([self.cents, vecs[i]]), np.append(self.count, 1.0)
                dots = np.column_stack([dots, gram[:, i]])
            out.append(self.labels[at])
        return out

    def close(self) -> list[tuple]:
        return []


class Bootstrapped:
    """The live rule from the first vector on. Takes (sub_idx, embedding, label, cents, threshold); gives (sub_idx, label).

    The first ``size`` vectors of a meeting are held and given with the bootstrap labels they bring, once all are there, a
    later one comes or the meeting ends; later ones go to the closest centroid.
    """

    def __init__(self, size: int) -> None:
        self.size, self.held, self.later = size, [], MovingCentroids(create=False)

    def feed(self, rows: dict) -> list[tuple]:
        first = rows["sub_idx"] < self.size
        self.held += [(i, int(label)) for i, label in zip(rows["sub_idx"][first].tolist(), rows["label"][first].tolist())]
        if first.all():
            return self.close() if len(self.held) >= self.size else []
        return self.close() + self.later.feed({c: v[~first] for c, v in rows.items()})

    def close(self) -> list[tuple]:
        out, self.held = self.held, []
        return out


def bootstrap_online(vecs: DataFrame, size: int = BOOTSTRAP_SIZE, create: bool = True) -> DataFrame:
    """Labels of the bootstrap vectors stay; later ones join the closest centroid, which moves on a clean match, or
    open a new label (``create``, the batch rule) or stay with the closest (the live rule)."""
    boot = bootstrap(vecs, size)
    cents = cut_lineage(centroids(boot))
    limit = calibrate_threshold(boot)
    packed = cents.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "centroid", "n"))).alias("cents"))
    setup = packed.join(limit, KEY)
    rest = vecs.filter(F.col("sub_idx") >= size)
    firsts = rest.groupBy(*KEY).agg(F.min("sub_idx").alias("_first")).join(setup, KEY)
    # the centroids travel with the first row of a meeting only
    fed = rest.join(firsts, KEY).withColumn("cents", F.when(F.col("sub_idx") == F.col("_first"), F.col("cents")))
    later = block_pass(
        fed, KEY, ["sub_idx"], ["sub_idx", "embedding", "cents", "threshold"], lambda: MovingCentroids(create),
        "meeting_id string, sub_idx int, label int",
    )
    return boot.select(*KEY, "sub_idx", "label").unionByName(later)


def bootstrap_assign(vecs: DataFrame, size: int = BOOTSTRAP_SIZE) -> DataFrame:
    """Bootstrap labels stay, the rest go to the closest bootstrap centroid, which does not move."""
    boot = bootstrap(vecs, size)
    rest = vecs.filter(F.col("sub_idx") >= size).withColumn("embedding", vectors.l2_normalize(F.col("embedding"), 1e-9))
    near = nearest_centroid(rest, centroids(boot)).select(*KEY, "sub_idx", F.col("label").cast("int").alias("label"))
    return boot.select(*KEY, "sub_idx", "label").unionByName(near)
