"""Splits, resampling, Gram-based selection and synthetic sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import featsel, resample, split
from cohortspark.operators.gram import gram, total
from cohortspark.sources import synthetic


def test_splits_partition_invariant(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in split.random_split(df.repartition(1), ["k"]).collect()}
    b = {r["k"]: r["split"] for r in split.random_split(df.repartition(7), ["k"]).collect()}
    assert a == b
    shares = {s: sum(1 for v in a.values() if v == s) / 2000 for s in ("train", "val", "test")}
    assert shares["train"] == pytest.approx(0.7, abs=0.05)


def test_stratified_quotas_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {(r["y"], r["split"]): r["count"] for r in split.stratified_split(df, "y", ["k"]).groupBy("y", "split").count().collect()}
    assert got[(1, "train")] == 70 and got[(1, "val")] == 15 and got[(1, "test")] == 15
    assert got[(0, "train")] == 630


def test_time_split_order(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.expr("timestamp_seconds(id * 60)").alias("ts"))
    s = split.time_split(df, "ts", "k")
    tr = s.where("split = 'train'").agg(F.max("k")).first()[0]
    va = s.where("split = 'val'").agg(F.min("k"), F.max("k")).first()
    assert tr == 349 and va[0] == 350 and va[1] == 349 + 75


def test_group_split_no_leak(spark):
    df = spark.range(3000).select((F.col("id") % 97).alias("g"), "id")
    s = split.group_split(df, "g")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_poisson_weights_mean_one():
    h = np.arange(20000, dtype=np.uint64) * np.uint64(2654435761)
    w = resample.poisson_weights(h, 50)
    assert w.mean() == pytest.approx(1.0, abs=0.02)
    assert w.var() == pytest.approx(1.0, abs=0.05)


def test_bootstrap_interval_brackets_estimate(spark):
    rng = np.random.default_rng(42)
    y = rng.normal(100, 20, 200)
    p = y + rng.normal(0, 10, 200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "k long, y double, p double")
    res = {r["metric"]: r for r in resample.bootstrap_metrics(df, "y", "p", key=["k"], n_resamples=300).collect()}
    for m in ("MAE", "RMSE", "R2"):
        assert res[m]["ci_lower"] <= res[m]["estimate"] <= res[m]["ci_upper"]
    assert res["RMSE"]["estimate"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))


def test_gram_by_key_sums_to_total(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(int(i % 4), *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double, c double")
    gs = gram(df, ["a", "b", "c"], by=["g"])
    t = total(gs)
    assert np.allclose(t.scatter, np.cov(x.T) * 299)
    assert np.allclose((t - gs["0"]).n, 300 - gs["0"].n)


def test_lasso_kkt(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = 3 * x[:, 0] + 2 * x[:, 1] - x[:, 2] + rng.normal(0, 0.5, 200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)],
                               "x0 double, x1 double, x2 double, x3 double, x4 double, y double")
    cols = ["x0", "x1", "x2", "x3", "x4"]
    g = total(gram(df, cols + ["y"]))
    alpha = 0.1
    a, b = featsel.lasso_cd(g, cols, "y", alpha)
    xc = x - x.mean(0)
    resid = (y - y.mean()) - xc @ b
    grad = xc.T @ resid / len(y)
    for j in range(5):
        if abs(b[j]) > 1e-8:
            assert grad[j] == pytest.approx(alpha * np.sign(b[j]), abs=1e-4)
        else:
            assert abs(grad[j]) <= alpha + 1e-4
    sel = featsel.univariate_screen(df, cols, "y").where("selected").select("feature").collect()
    assert {"x0", "x1"} <= {r["feature"] for r in sel}


def test_consensus(spark):
    df = spark.createDataFrame([("A", "a"), ("A", "b"), ("A", "c"), ("B", "b"), ("B", "c"), ("B", "d")],
                               "method string, feature string")
    got = sorted(r["feature"] for r in featsel.consensus(df, 2).collect())
    assert got == ["b", "c"]


def test_synthetic_shapes(spark):
    d = synthetic.linear_with_outliers(spark)
    assert d.count() == 500 and set(d.columns) >= {"feature_1", "feature_2", "target"}
    c = synthetic.imbalanced_classification(spark).agg(F.avg("target")).first()[0]
    assert 0.05 < c < 0.4
    a = synthetic.nonlinear_regression(spark, seed=1).orderBy("id").limit(5).collect()
    b = synthetic.nonlinear_regression(spark, seed=1).repartition(3).orderBy("id").limit(5).collect()
    assert a == b


def test_exact_selection_quantiles(spark):
    import cohortspark.functions.quantiles as Q
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=3000).round(2), np.full(1500, 0.5), [np.nan] * 10])
    df = spark.createDataFrame([(None if np.isnan(v) else float(v),) for v in vals], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.73, 1.0]
    old = Q.BAND_LIMIT
    try:
        for lim in (50_000, 50):
            Q.BAND_LIMIT = lim
            got = Q.exact_quantiles(df, ["x"], probs)["x"]
            exp = np.quantile(vals[~np.isnan(vals)], probs)
            assert got == pytest.approx(list(exp), abs=1e-12)
    finally:
        Q.BAND_LIMIT = old


def test_outlier_bounds_select_matches_exact(spark):
    from cohortspark.operators import outliers
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(v),) for v in rng.standard_t(3, 2000)], "x double")
    for m in ("iqr", "mad", "percentile"):
        a = outliers.fit_bounds(df, ["x"], m)["x"]
        b = outliers.fit_bounds(df, ["x"], m, quantile_method="select")["x"]
        assert a.lower == pytest.approx(b.lower) and a.upper == pytest.approx(b.upper)


def test_profile_partition_invariant(spark):
    from cohortspark.operators import profile
    rng = np.random.default_rng(11)
    rows = [(float(v), int(k), str(s)) for v, k, s in zip(rng.normal(size=400).round(1), rng.integers(0, 9, 400),
                                                            rng.choice(list("abc"), 400))]
    df = spark.createDataFrame(rows, "x double, k int, s string")
    a = sorted(map(tuple, profile.feature_profile(df.repartition(1)).collect()), key=str)
    b = sorted(map(tuple, profile.feature_profile(df.repartition(7)).collect()), key=str)
    for ra, rb in zip(a, b):
        for va, vb in zip(ra, rb):
            if isinstance(va, float):
                assert va == pytest.approx(vb)
            else:
                assert va == vb


def test_stream_applies_fitted_scaler(spark, tmp_path):
    from cohortspark.operators import preprocess
    from cohortspark.streaming import apply as st
    src = tmp_path / "in"
    out = tmp_path / "out"
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2.0).alias("v"))
    df.write.parquet(str(src))
    scaler = preprocess.fit_scaler(df, ["v"], "standard")
    stream = st.read_stream(spark, str(src), df.schema)
    qy = st.write_parquet_batches(st.transform_stream(stream, scaler), str(out), name=f"t{abs(hash(str(out)))}")
    qy.awaitTermination()
    got = spark.read.parquet(str(out)).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert got[0] == pytest.approx(0.0, abs=1e-9) and got[1] == pytest.approx(1.0)
