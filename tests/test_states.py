"""Vector states against plain sums, and what they send."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import states
from framewright.operators.pooling import chunk_sums, mean_pool, weighted_mean_pool


def plain(rows):
    """``{key: (mean by dimension, n)}`` of ``(key, vector or None, weight)``."""
    by = defaultdict(list)
    for k, v, w in rows:
        if v:
            by[k].append((v, w or 0))
    out = {}
    for k, found in by.items():
        mean = []
        for d in range(max(len(v) for v, _ in found)):
            has = [(v[d], w) for v, w in found if d < len(v) and v[d] is not None]
            n = sum(w for _, w in has)
            mean.append(sum(x for x, _ in has) / n if n else None)
        n = sum(w for _, w in found)
        out[k] = (mean, n)
    return out


def same(got, want):
    assert {r.k for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        mean, n = want[r.k]
        assert r.n_frames == n and len(r.vec) == len(mean)
        assert all(x is None if y is None else abs(x - y) < 1e-9 for x, y in zip(r.vec, mean))


@pytest.mark.parametrize("held", [4, 2048])
def test_means_of_odd_vectors(spark, monkeypatch, held):
    monkeypatch.setattr(states, "HELD", held)
    rng = np.random.default_rng(held)
    rows = []
    for i in range(700):
        v = [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=rng.integers(1, 6))]
        k = "hot" if i % 3 == 0 else [None, "", "a", "b"][rng.integers(4)] if i % 3 == 1 else f"k{rng.integers(200)}"
        rows.append((k, None if i % 50 == 7 else [] if i % 50 == 8 else v, 1))
    df = spark.createDataFrame(rows, "k string, vec array<double>, w long").repartition(5)
    same(mean_pool(df, ["k"]).collect(), plain(rows))


def test_several_keys_and_long_integers(spark):
    big = 2**60
    rows = [(big + i % 3, None if i % 4 == 0 else i % 2, [float(i), 1.0]) for i in range(200)]
    got = mean_pool(spark.createDataFrame(rows, "a long, b int, vec array<double>").repartition(4), ["a", "b"]).collect()
    want = plain([((a, b), v, 1) for a, b, v in rows])
    assert {(r.a, r.b): (r.vec, r.n_frames) for r in got} == {k: (m, n) for k, (m, n) in want.items()}


def test_weights_are_counts(spark):
    rows = [("x", [2.0, 4.0], 2), ("x", [1.0, 0.0], 1), ("y", [5.0], 0), ("z", None, 3), ("w", [1.0], None)]
    got = {r.k: (r.vec, r.n_frames) for r in weighted_mean_pool(spark.createDataFrame(rows, "k string, sum_vec array<double>, n_frames long"), ["k"]).collect()}
    assert got == {"x": ([1.0, 4 / 3], 3), "y": (None, 0), "w": (None, 0)}


def test_chunk_sums_add_up_to_the_mean(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 4), int(i % 11), [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, c int, vec array<float>").repartition(6)
    a = {r.k: r for r in mean_pool(df, ["k"]).collect()}
    for r in weighted_mean_pool(chunk_sums(df, ["k"], "c"), ["k"]).collect():
        assert r.n_frames == a[r.k].n_frames == 125 and np.allclose(r.vec, a[r.k].vec)


def test_a_task_sends_one_state_for_each_key(spark):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 5).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    plan = mean_pool(df, ["k"])
    assert {r.k: r.n_frames for r in plan.collect()} == dict.fromkeys(range(5), 8000)
    sent = 0
    node = [plan._jdf.queryExecution().executedPlan()]
    while node:
        x = node.pop()
        if x.getClass().getSimpleName() == "ShuffleExchangeExec":
            sent += x.metrics().apply("shuffleRecordsWritten").value()
        if x.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node.append(x.executedPlan())
        elif "QueryStageExec" in x.getClass().getSimpleName():
            node.append(x.plan())
        children = x.children()
        node += [children.apply(i) for i in range(children.size())]
    assert sent == 8 * 5


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "k int, vec array<double>")
    assert mean_pool(df, ["k"]).count() == 0 and mean_pool(df.limit(0), ["k"]).count() == 0
