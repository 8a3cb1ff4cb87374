"""Requests of one batch that clash, and meetings with many vectors."""

import numpy as np

from palaver.operators import catalog, clusters


def test_one_label_goes_to_one_request(spark):
    jobs = spark.createDataFrame([("a", "done", "A", None), ("b", "done", "B", None), ("c", "done", "C", None)], "id string, status string, label string, folder string")
    asked = spark.createDataFrame([("a", "Same"), ("b", "Same"), ("c", "C")], "id string, new_label string")
    got = {r["id"]: (r["error_code"], r["label"]) for r in catalog.rename(jobs, asked).collect()}
    assert got == {"a": (None, "Same"), "b": ("exists", "B"), "c": (None, "C")}


def test_one_place_goes_to_one_request(spark):
    jobs = spark.createDataFrame([("a", "done", "L", None), ("b", "done", "L", "x"), ("c", "done", "M", None)], "id string, status string, label string, folder string")
    asked = spark.createDataFrame([("a", "new", 2), ("b", "new", 1), ("c", "new", 3)], "id string, new_folder string, no int")
    got = {r["id"]: (r["error_code"], r["folder"]) for r in catalog.move(jobs, asked, order="no").collect()}
    assert got == {"a": ("exists", None), "b": (None, "new"), "c": (None, "new")}


def test_one_folder_is_made_once(spark):
    asked = spark.createDataFrame([("N:",), ("N?",), ("  ",)], "name string")
    got = {r["name"]: r["error_code"] for r in catalog.folder_create(asked, spark.createDataFrame([], "folder string")).collect()}
    assert got == {"N:": None, "N?": "exists", "  ": "invalid"}


def test_pairs_cover_a_long_meeting(spark):
    n = 1200
    v = np.random.default_rng(3).normal(size=(n, 4))
    vecs = spark.createDataFrame([("m", i, i % 3, [float(x) for x in v[i]]) for i in range(n)], "meeting_id string, sub_idx int, label int, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = (unit @ unit.T)[np.triu_indices(n, 1)]
    got = clusters.pair_percentile(vecs, 0.3).first()
    assert got["n"] == n * (n - 1) // 2
    assert abs(got["pct"] - np.quantile(1 - sims, 0.3)) < 1e-9
    assert clusters.knn_graph(vecs, 6).select("j").distinct().count() == n
