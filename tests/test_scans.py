"""Bucketed scans against brute force, with one key that holds most rows and buckets of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from palaver.plans.scans import by_index, exact_percentile, frames, islands, ordered_pass, scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for key, n in (("hot", 200), ("a", 9), ("b", 1)):
        for i in range(n):
            out.append((key, i, None if rng.random() < 0.3 else rng.randint(0, 50), rng.choice("xyz")))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, v int, s string")


def per_key(rows):
    for key in {r[0] for r in rows}:
        yield key, sorted((r for r in rows if r[0] == key), key=lambda r: r[1])


def test_scan_kinds(table, rows):
    specs = {
        f"{kind}{side}": (kind + side, F.col("v"))
        for kind in ("sum", "max", "last") for side in ("", "_before")
    } | {"next": ("next", F.col("v")), "next_after": ("next_after", F.col("v")), "lag": ("lag", F.col("v")), "lead": ("lead", F.col("v"))}
    got = {(r.k, r.i): r.asDict() for r in scan(table, ["k"], ["i"], by_index("i", 7), specs).collect()}
    for key, seq in per_key(rows):
        vals = [r[2] for r in seq]
        for i in range(len(vals)):
            upto, before = [v for v in vals[: i + 1] if v is not None], [v for v in vals[:i] if v is not None]
            onward, after = [v for v in vals[i:] if v is not None], [v for v in vals[i + 1 :] if v is not None]
            want = {
                "sum": sum(upto), "sum_before": sum(before), "max": max(upto, default=None), "max_before": max(before, default=None),
                "last": upto[-1] if upto else None, "last_before": before[-1] if before else None,
                "next": onward[0] if onward else None, "next_after": after[0] if after else None,
                "lag": vals[i - 1] if i else None, "lead": vals[i + 1] if i + 1 < len(vals) else None,
            }
            assert {c: got[key, i][c] for c in want} == want


def test_islands(table, rows):
    out = islands(table, ["k"], ["i"], by_index("i", 5), ["s"], lambda cur, prev: cur("s") != prev("s"), "run")
    got = {(r.k, r.i): r.run for r in out.collect()}
    for key, seq in per_key(rows):
        run = 0
        for j, r in enumerate(seq):
            run += j == 0 or seq[j - 1][3] != r[3]
            assert got[key, r[1]] == run


def test_frames(table, rows):
    out = frames(table, ["k"], "i", 3, 2, lambda w: {"n": F.collect_list("i").over(w.rowsBetween(-3, 2))}, rows=8)
    got = {(r.k, r.i): r.n for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for key, seq in per_key(rows):
        for i in range(len(seq)):
            assert got[key, i] == list(range(max(0, i - 3), min(len(seq), i + 3)))


@pytest.mark.parametrize("p", [0.0, 0.05, 0.37, 0.5, 1.0])
def test_exact_percentile(table, rows, p):
    got = {r.k: r.pct for r in exact_percentile(table, ["k"], "v", p, bins=8).collect()}
    for key, seq in per_key(rows):
        vals = sorted(r[2] for r in seq if r[2] is not None)
        if not vals:
            assert key not in got
            continue
        pos = p * (len(vals) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(vals) - 1)
        assert got[key] == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (pos - lo))


def test_ordered_pass_crosses_batches(spark, table, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = ordered_pass(
            table, ["k"], ["i"], ["i"], list, lambda st, r: (st.append(r[0]) or []), lambda st: [(len(st), st == sorted(st))],
            "k string, n int, ok boolean",
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: (r.n, r.ok) for r in out} == {key: (len(seq), True) for key, seq in per_key(rows)}
