"""Clusters and speaker counts of each meeting against dense matrices and planted voices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.operators import clusters, pairs, spectral

VEC = "meeting_id string, sub_idx int, label int, embedding array<double>"
BAD = [("a", 900, 0, None), ("a", 901, 0, []), ("b", 902, 0, [0.0] * 12), ("a", 903, 1, [1.0, None] + [0.0] * 10), ("z", 0, 0, None), ("b", 904, 1, [1.0, 2.0])]


def voices(meeting, seed, n, k, spread, dim=12):
    rng = np.random.default_rng(seed)
    at = rng.permutation(dim)[:k]
    v = np.eye(dim)[at[np.arange(n) % k]] + spread * rng.normal(size=(n, dim))
    return [(meeting, i, int(i % k), [float(x) for x in v[i]]) for i in range(n)]


@pytest.fixture(scope="module")
def planted():
    return voices("a", 1, 60, 2, 0.08) + voices("b", 2, 45, 3, 0.08) + voices("c", 3, 40, 1, 0.08)


def test_points_are_eigenvectors_of_the_dense_affinity(spark, planted):
    table = spark.createDataFrame(planted + BAD, VEC).repartition(5)
    got = spectral.spectral_points(table, 3).collect()
    assert {r.meeting_id for r in got} == {"a", "b", "c"}
    for m in "abc":
        x = np.array([r[3] for r in planted if r[0] == m])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        dense = (x @ x.T + 1) / 2
        root = np.sqrt(dense.sum(axis=1))
        values, axes = np.linalg.eigh(dense / root[:, None] / root[None, :])
        plain = (axes[:, ::-1][:, :3]) / root[:, None]
        mine = np.array([r.y for r in sorted((r for r in got if r.meeting_id == m), key=lambda r: r.sub_idx)])
        assert len(mine) == len(x)
        assert np.allclose(mine * np.sign((mine * plain).sum(axis=0)), plain, atol=1e-8)


def test_planted_speakers_of_every_meeting(spark, planted):
    table = spark.createDataFrame(planted + BAD, VEC).repartition(5)
    for k, meetings in ((2, "a"), (3, "b")):
        got = {(r.meeting_id, r.sub_idx): r.label for r in spectral.cluster_affinity(table, k).collect()}
        assert len(got) == len(planted) + len(BAD)
        assert all(got[b[0], b[1]] is None for b in BAD)
        for m in meetings:
            assert all(got[r[0], r[1]] == r[2] for r in planted if r[0] == m)


def test_cluster_edge_cases(spark):
    one = [("x", 0, 0, [1.0, 0.0])] + [("same", i, 0, [0.5, 0.5]) for i in range(6)] + [("two", 0, 0, [1.0, 0.0]), ("two", 1, 0, [0.0, 1.0])]
    got = {(r.meeting_id, r.sub_idx): r.label for r in spectral.cluster_affinity(spark.createDataFrame(one, VEC), 4).collect()}
    assert got == {("x", 0): 0, **{("same", i): 0 for i in range(6)}, ("two", 0): 0, ("two", 1): 1}
    assert spectral.cluster_affinity(spark.createDataFrame([], VEC), 4).count() == 0


def test_principal_points(spark, planted):
    got = spectral.principal_points(spark.createDataFrame(planted, VEC).repartition(4), 4).filter("meeting_id = 'b'").collect()
    x = np.array([r[3] for r in planted if r[0] == "b"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(axis=0)
    plain = x @ np.linalg.svd(x, full_matrices=False)[2][:4].T
    mine = np.array([r.y for r in sorted(got, key=lambda r: r.sub_idx)])
    assert np.allclose(mine * np.sign((mine * plain).sum(axis=0)), plain, atol=1e-8)


def counted(table, **kw):
    return spectral.cluster_count_bic(table, clusters.single_speaker(table), **kw).collect()


def test_speaker_counts_of_planted_meetings(spark, planted):
    """Two and three voices are counted each in its meeting; one voice, and too few vectors, are known without a mixture."""
    rows = counted(spark.createDataFrame(planted + BAD + voices("few", 5, 3, 1, 0.1), VEC).repartition(3), max_k=6, dims=3)
    best = {r.meeting_id: r.k for r in rows if r.best}
    assert best == {"a": 2, "b": 3, "c": 1, "few": 1, "z": 1}
    assert sorted(r.k for r in rows if r.meeting_id == "a") == [1, 2, 3, 4, 5, 6]
    assert all(r.bic is None for r in rows if r.meeting_id in ("c", "few", "z"))


def test_one_gaussian_has_a_closed_form(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(80, 6))
    table = spark.createDataFrame([("m", i, 0, [float(v) for v in r]) for i, r in enumerate(x)], VEC)
    rows = {r.k: r for r in counted(table, max_k=2)}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain = 80 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(np.cov(x.T, bias=True))[1] + 6) + 27 * np.log(80)
    assert rows[1].best and not rows[2].best and abs(rows[1].bic - plain) < 1e-4 * abs(plain)
    # blocks and the points of the start change nothing but rounding
    monkeypatch.setattr(spectral, "POINTS_IN_BLOCK", 7)
    again = {r.k: r.bic for r in counted(table, max_k=2)}
    assert all(abs(again[k] - rows[k].bic) < 1e-6 * abs(rows[k].bic) for k in again)


def test_all_points_refine_the_start(spark, monkeypatch):
    """With a start from few points the mixtures still fit all of them."""
    rows = voices("m", 9, 400, 2, 0.1, dim=4)
    table = spark.createDataFrame(rows, VEC)
    monkeypatch.setattr(spectral, "STARTING_POINTS", 40)
    got = {r.k: r for r in counted(table, max_k=3, dims=2)}
    assert got[2].best


def test_sweep_is_whole(spark):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([("m", i, 0, rng.normal(size=5).tolist()) for i in range(16)], VEC)
    assert sorted(r.k for r in counted(table, dims=2)) == list(range(1, 9))
    assert [(r.k, r.best) for r in counted(table, min_k=12, max_k=5, dims=2)] == [(12, True)]


def test_repeated_vectors_and_many_partitions(spark):
    table = spark.range(30).select(F.lit("m").alias("meeting_id"), F.col("id").cast("int").alias("sub_idx"), F.lit(0).alias("label"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding")).repartition(9)
    got = {r.sub_idx: r.label for r in spectral.cluster_affinity(table, 2).collect()}
    assert got == {i: i % 2 for i in range(30)}


def test_long_rows_are_taken_some_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array([[float(i)] * 3 for i in range(150)])], ["i", "v"])
    parts = list(pairs.few([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [64, 64, 22]
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()

