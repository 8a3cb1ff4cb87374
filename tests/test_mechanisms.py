"""Block products, assignments and versioned tables against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import assignment, clusters, diarization, pairs
from palaver.sources.versioned import VersionedTable

VECS = "meeting_id string, sub_idx int, label int, embedding array<double>"


@pytest.fixture(scope="module")
def vectors_of():
    rng = np.random.default_rng(4)
    rows = []
    for meeting, n in (("a", 90), ("b", 7), ("c", 1), ("d", 2)):
        for i in range(n):
            v = rng.normal(size=6)
            rows.append((meeting, i, int(rng.integers(3)), v.tolist()))
    rows += [("a", 90 + i, 0, rows[3][3]) for i in range(8)]  # ties
    return rows


BAD = [("a", 500, 0, None), ("a", 501, 1, []), ("a", 502, 1, [0.0] * 6), ("a", 503, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("b", 504, 0, [float("nan")] * 6), ("e", 0, 0, None), ("b", 505, 1, [float("inf")] * 6)]


def sims_of(rows, meeting):
    mine = [r for r in rows if r[0] == meeting]
    v = np.array([r[3] for r in mine])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return mine, v @ v.T


def test_pair_percentiles_by_narrowing_down(spark, vectors_of):
    table = spark.createDataFrame(vectors_of + BAD, VECS).repartition(5)
    got = {(r.meeting_id, r.cls): (r.n, r.pct) for r in pairs.percentiles(table, {"all": 0.3, "same": 0.1, "other": 0.9}, block=16).collect()}
    expected = {}
    for m in "abd":
        mine, sims = sims_of(vectors_of, m)
        upper = [(i, j) for i, j in itertools.combinations(range(len(mine)), 2)]
        for cls, p, keep in (("all", 30, lambda i, j: True), ("same", 10, lambda i, j: mine[i][2] == mine[j][2]), ("other", 90, lambda i, j: mine[i][2] != mine[j][2])):
            values = [sims[i, j] for i, j in upper if keep(i, j)]
            if values:
                expected[m, cls] = (len(values), np.percentile(values, p))
    assert set(got) == set(expected)
    for k, (n, pct) in expected.items():
        assert got[k][0] == n and abs(got[k][1] - pct) < 1e-10


def test_nearest_lists_keep_ties(spark, vectors_of):
    table = spark.createDataFrame(vectors_of + BAD, VECS).repartition(5)
    got = {(r.meeting_id, r.j, r.i) for r in clusters.knn_graph(table, 5).collect()}
    small = {(r.meeting_id, r.i, r.j) for r in pairs.nearest(table, 5, lambda s: (s + 1) / 2, block=16).collect()}
    expected = set()
    for m in "abcd":
        mine, sims = sims_of(vectors_of, m)
        sims = np.round(sims, 12)
        np.fill_diagonal(sims, 1.0)
        for i, row in enumerate(sims):
            limit = np.sort(row)[::-1][min(5, len(row)) - 1]
            expected |= {(m, mine[i][1], mine[j][1]) for j in range(len(row)) if row[j] >= limit}
    # tied vectors are at 1 of one another, within rounding of the diagonal
    assert {x for x in got ^ expected if x[1] < 90 and x[2] < 90 and 3 not in x[1:]} == set()
    assert got == small


def test_no_row_per_pair(spark):
    n = 1200
    vecs = spark.range(n).selectExpr("'m' AS meeting_id", "cast(id AS int) AS sub_idx", "cast(id % 3 AS int) AS label", "array(cos(id), sin(id), 0.1D) AS embedding")
    plan = pairs.met(pairs.blocks(vecs))
    assert plan.count() == 15  # five blocks, each pair once
    got = clusters.pair_percentile(vecs, 0.3).first()
    x = np.array([[np.cos(i), np.sin(i), 0.1] for i in range(n)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - (x @ x.T)[np.triu_indices(n, 1)]
    assert got.n == n * (n - 1) // 2 and abs(got.pct - np.percentile(d, 30)) < 1e-10


def test_unusable_vectors_have_no_label_and_no_edge(spark, vectors_of):
    table = spark.createDataFrame(vectors_of + BAD, VECS).repartition(3)
    clean = spark.createDataFrame(vectors_of, VECS)
    for op in (clusters.centroids, clusters.silhouette, clusters.calibrate_threshold, clusters.single_speaker):
        a, b = ({str(r) for r in op(t).filter("meeting_id <> 'e'").collect()} for t in (table, clean))
        assert len(a) == len(b)
    near = {(r.meeting_id, r.sub_idx): r.label for r in clusters.nearest_centroid(table, clusters.centroids(clean)).collect()}
    assert near["a", 500] is None and near["b", 505] is None and near["a", 0] is not None
    assert {(r.meeting_id, r.i) for r in clusters.affinity_edges(table).collect()} == {(m, i) for m, i, _, _ in vectors_of}


def test_reachable_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = pairs.cut_lineage
    monkeypatch.setattr(pairs, "cut_lineage", lambda df: (rounds.append(1), real(df))[1])
    chain = [("m", i, i + 1) for i in range(1000)]
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame([*chain, ("m", 2000, 2001), ("n", 5, 5)], "meeting_id string, i long, j long").repartition(4)
    got = {(r.meeting_id, r.node): r.root for r in pairs.reachable(edges).collect()}
    assert got == {("m", i): 0 for i in range(1001)} | {("m", 2000): 2000, ("m", 2001): 2000, ("n", 5): 5}
    assert (len(rounds) - 2) / 2 <= 12
    flags = {r.meeting_id: r.connected for r in clusters.connected(edges.withColumn("v", F.lit(1.0))).collect()}
    assert flags == {"m": False, "n": True}


def test_best_columns_is_optimal():
    rng = np.random.default_rng(1)
    for n in range(300):
        rows = int(rng.integers(1, 7))
        columns = int(rng.integers(rows, 8))
        w = rng.integers(0, 6, size=(rows, columns)).astype(float) if n % 2 else rng.random((rows, columns))
        at = assignment.best_columns(w)
        assert len(set(at.tolist())) == rows
        best = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(columns), rows))
        assert abs(w[np.arange(rows), at].sum() - best) < 1e-9


def test_optimal_map_beats_greedy(spark):
    rows = [("m", "R0", "H0", 10.0), ("m", "R0", "H1", 9.0), ("m", "R1", "H0", 9.0), ("m", "R1", "H1", 1.0), ("m", None, "H1", 99.0), ("n", "R0", "H5", 2.0), ("n", "R1", "H5", 3.0), ("o", "R0", "H0", 0.0)]
    table = spark.createDataFrame(rows, "meeting_id string, r_spk string, h_spk string, overlap_s double")
    assert {tuple(r) for r in assignment.optimal_map(table).collect()} == {("m", "R0", "H1"), ("m", "R1", "H0"), ("n", "R1", "H5")}
    assert assignment.optimal_map(table.limit(0)).collect() == []


def test_error_rate_uses_the_best_map(spark):
    seg = "meeting_id string, speaker string, start double, end double"
    ref = spark.createDataFrame([("m", "A", 0.0, 19.0), ("m", "B", 19.0, 29.0)], seg)
    hyp = spark.createDataFrame([("m", "x", 0.0, 10.0), ("m", "y", 10.0, 19.0), ("m", "x", 19.0, 28.0), ("m", "y", 28.0, 29.0)], seg)
    r = diarization.der_components(ref, hyp, collar_s=0.0).first()
    assert abs(r.confusion - 11.0 / 29.0) < 1e-9  # A-y and B-x agree for 18 s, greedily A-x and B-y for 11 s


def test_versioned_table(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('k', id) AS id", "id AS n")
    table = VersionedTable.create(rows, str(tmp_path / "t"), "id", buckets=8)
    before = table.read()
    keys = spark.createDataFrame([("k3",), ("k7",)], "id string")

    def change(part):
        return part.join(keys.withColumn("hit", F.lit(True)), "id", "left").withColumn("n", F.when(F.col("hit"), -F.col("n")).otherwise(F.col("n"))).drop("hit")

    assert table.apply(keys, change, 5, "s") == 1
    assert {r.id: r.n for r in table.read().collect()} == {f"k{i}": -i if i in (3, 7) else i for i in range(100)}
    assert {r.id: r.n for r in before.collect()} == {f"k{i}": i for i in range(100)}  # begun before, reads its version
    assert table.apply(keys, change, 5, "s") == 1 and table.version() == 1  # a replayed batch
    assert table.apply(keys, change, 5, "other") == 2
    folders = [table._folders(v) for v in (0, 1)]
    assert sum(folders[0][b] != folders[1][b] for b in range(8)) <= 2  # only touched buckets are written
    table.apply(keys, lambda part: part.join(keys, "id", "left_anti"), 6, "s")
    assert table.read().count() == 98 and table.read(0).count() == 100
    with pytest.raises(Exception, match="exists"):
        table._publish(3, folders[0], 7, "s")


def test_versioned_table_as_a_sink(spark, tmp_path):
    table = VersionedTable.create(spark.range(20).selectExpr("id", "0L AS n"), str(tmp_path / "t"), "id", buckets=4)
    for i in range(3):
        spark.range(i, 20, 3).selectExpr("id", "1L AS add").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def change(part, batch):
        return part.join(batch.groupBy("id").agg(F.sum("add").alias("add")), "id", "left").select("id", (F.col("n") + F.coalesce("add", F.lit(0))).alias("n"))

    sink = table.sink(change, "requests")

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = spark.readStream.schema("id long, add long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.n for r in table.read().collect()} == {1} and table.version() == 3
