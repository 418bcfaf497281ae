"""Findings of round 3: work and memory that grew faster than the input; results against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models as md


def _points(spark, n=400, p=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = rng.integers(0, 3, n).astype(float)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(p)) + ", y double")


@pytest.mark.parametrize("task", ["regression", "classification"])
@pytest.mark.parametrize("cells", [0, 10 ** 9])
def test_knn_blocks(spark, monkeypatch, task, cells):
    """rows of training data in several blocks and tiles, on both sides, give the plain result."""
    monkeypatch.setattr(md, "KNN_CELLS", 150)
    monkeypatch.setattr(md, "KNN_QUERIES", 32)
    monkeypatch.setattr(md, "KNN_TILE", (16, 24))
    x, y, df = _points(spark)
    m = md.fit_knn(df.where("id < 300"), ["x0", "x1", "x2"], "y", 5, "uniform", task, broadcast_cells=cells)
    assert (m.train is None) == (cells > 0)
    got = {r["id"]: r["prediction"] for r in m.transform(df.where("id >= 300").repartition(3)).collect()}
    assert sorted(got) == list(range(300, 400))
    for i, v in got.items():
        near = y[:300][np.argsort(((x[:300] - x[i]) ** 2).sum(1))[:5]]
        want = near.mean() if task == "regression" else np.argmax([(near == c).sum() for c in range(3)])
        assert v == pytest.approx(want)


def test_knn_memory_does_not_follow_training_rows():
    """one call held several matrices of 512 x all training rows."""
    import tracemalloc
    rng = np.random.default_rng(2)
    tx, ty, x = rng.normal(size=(200_000, 2)), rng.normal(size=200_000), rng.normal(size=(512, 2))
    tracemalloc.start()
    md._nearest(x, tx, ty, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20


@pytest.mark.parametrize("cells", [16, 1 << 14])
def test_many_quantiles_in_few_scans(spark, monkeypatch, cells):
    """the plan of a scan does not grow with the number of probabilities; any doubles, any group."""
    from cohortspark.functions import quantiles as Q
    monkeypatch.setattr(Q, "CELLS", cells)
    monkeypatch.setattr(Q._Plan, "counts", None)  # not the expressions per probability
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), np.zeros(200), np.full(50, -0.0)])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(x, g)] + [(None, 0), (None, None)], "x double, g int")
    probs = [(i + 0.5) / 100 for i in range(100)] + [0.0, 1.0]
    got = Q.exact_quantiles(df, ["x"], probs)["x"]
    assert got == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    rows = Q.group_quantiles(df, {"x": F.col("x")}, probs, {"g": F.col("g")}).collect()
    assert sorted(r["g"] for r in rows if r["g"] is not None) == [0, 1, 2] and len(rows) == 4
    for r in rows:
        if r["g"] is None:
            assert r["n"] == 0 and r["q"] is None
        else:
            assert r["q"] == pytest.approx(np.quantile(x[g == r["g"]], probs).tolist(), rel=1e-12)


def test_fourier_features_stay_in_the_task(spark):
    """the fit adds up its features' Gram in numpy; no column per feature in a plan."""
    x, y, df = _points(spark, 300)
    m = md.fit_rbf_svm(df, ["x0", "x1", "x2"], "y", n_components=20)
    z = np.sqrt(2 / 20) * np.cos(x @ m.w.T + m.b)
    zc, yc = z - z.mean(0), y - y.mean()
    coef = np.linalg.solve(zc.T @ zc + np.eye(20), zc.T @ yc)
    out = m.transform(df.unionByName(df.limit(1).withColumn("x0", F.lit(None).cast("double")).withColumn("id", F.lit(-1).cast("long"))))
    assert "__rff" not in out._jdf.queryExecution().toString()
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert got.pop(-1) is None
    np.testing.assert_allclose([got[i] for i in range(300)], y.mean() + zc @ coef, rtol=1e-8)


def test_subgroups_draw_weights_once(spark, monkeypatch):
    """groups and Overall come from one set of weights a row, and equal runs on the groups alone."""
    from cohortspark.operators import resample as rs
    rng = np.random.default_rng(4)
    y = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(v), float(v + e), "abc"[i % 3]) for i, (v, e) in enumerate(
        zip(y, rng.normal(size=500)))], "id long, y double, p double, g string")
    seen = []
    inner = rs._partials
    monkeypatch.setattr(rs, "_partials", lambda *a, **k: seen.append(a) or inner(*a, **k))
    cols = ["metric", "n", "estimate", "ci_lower", "ci_upper"]

    def rows(d, **k):
        return sorted(tuple(r) for r in rs.bootstrap_metrics(d, "y", "p", key=["id"], n_resamples=100, **k).select(cols).collect())

    def grouped(name):
        made = rs.bootstrap_metrics(df, "y", "p", key=["id"], n_resamples=100, by="g")
        return sorted(tuple(r) for r in made.where(F.col("group") == name).select(cols).collect())

    for name, part in [("Overall", df), ("a", df.where("g = 'a'"))]:
        for got, want in zip(grouped(name), rows(part), strict=True):
            assert got[:2] == want[:2]
            assert got[2:] == pytest.approx(want[2:], rel=1e-9)
    assert seen[0][5] is not None and seen[1][5] is None
