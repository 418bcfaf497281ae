"""Repeated keys, encodings, deep imputation chains, leakage: each result against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.columns import explode_copies
from cohortspark.operators import explain, htest, models
from cohortspark.operators import preprocess as pp
from cohortspark.plans.pipeline import PreprocessConfig, fit_pipeline
from cohortspark.sources import io


def _linear():
    return models.LinearExpr("m", ["a", "b"], 0.0, [2.0, -3.0], "regression")


@pytest.fixture(scope="module")
def repeated(spark):
    """500 keys of two rows that differ, and 40 rows that are all alike."""
    rows = [(k, float(k + 500 * c), float(c)) for k in range(500) for c in range(2)] + [(1000, 7.0, 7.0)] * 40
    df = spark.createDataFrame(rows, "k long, a double, b double")
    return df.withColumn("y", 2 * F.col("a") - 3 * F.col("b"))


def test_explode_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("cohortspark.functions.columns.COPY_CHUNK", 3)
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 7)], "x string, n long")
    got = sorted(tuple(r) for r in explode_copies(df, "n", "i").select("x", "i").collect())
    assert got == [("a", 0)] + [("b", i) for i in range(3)] + [("c", i) for i in range(7)]


def test_shapley_with_repeated_keys(repeated):
    got = explain.sampled_shapley(_linear(), repeated, ["k"], n_permutations=3)
    mean_a, mean_b = repeated.agg(F.avg("a"), F.avg("b")).first()
    want = sorted([("a", round(2 * (r.a - mean_a), 6)) for r in repeated.collect()]
                  + [("b", round(-3 * (r.b - mean_b), 6)) for r in repeated.collect()])
    assert sorted((r.feature, round(r.shap, 6)) for r in got.collect()) == want


def test_permutation_importance_keeps_every_row(repeated, monkeypatch):
    seen = []
    real = models.LinearExpr.transform

    def spy(self, df):
        if "rep" in df.columns:
            seen.append({(r["feature"], r["rep"]): r["n"] for r in df.groupBy("feature", "rep").agg(F.count("*").alias("n")).collect()})
        return real(self, df)

    monkeypatch.setattr(models.LinearExpr, "transform", spy)
    out = {r["feature"]: r for r in explain.permutation_importance(_linear(), repeated, "y", "regression", ["k"], 3).collect()}
    assert set(seen[0].values()) == {1040} and len(seen[0]) == 6
    assert out["a"]["importance_mean"] > 0.5 and out["a"]["n_repeats"] == 3


def test_normality_sample_is_of_rows(spark):
    df = spark.range(20000).select((F.col("id") % 50).cast("double").alias("x"))
    vals = htest.normality_sample(df, "x", max_n=5000)
    assert len(vals) == 5000 and len(set(vals)) == 50
    assert max(np.bincount(np.array(vals, int))) < 200


def test_csv_replacement_character_is_utf8(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name,v\ncafé,1\nbad�mark,2\n".encode())
    (tmp_path / "l.csv").write_bytes("name,v\ncafé,1\n".encode("latin-1"))
    assert [r["name"] for r in io.load_csv(spark, str(tmp_path / "u.csv")).orderBy("v").collect()] == ["café", "bad�mark"]
    assert [r["name"] for r in io.load_csv(spark, str(tmp_path / "l.csv")).collect()] == ["café"]


def test_iterative_imputer_ten_rounds(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 1))
    x = z + 0.3 * rng.normal(size=(300, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, c0 double, c1 double, c2 double, c3 double")
    cols = ["c0", "c1", "c2", "c3"]
    imp = pp.fit_iterative_imputer(df, cols, max_iter=10, tol=0.0)
    assert len(imp.rounds) == 10
    out = imp.transform(df)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    got = np.array([[r[c] for c in cols] for r in out.orderBy("i").collect()])
    cur = np.where(np.isnan(x), [imp.init[c] for c in cols], x)
    for rnd in imp.rounds:
        for j, c in enumerate(cols):
            a, b = rnd[c]
            pred = a + np.delete(cur, j, 1) @ np.array(b)
            cur[:, j] = np.where(np.isnan(x[:, j]), pred, x[:, j])
    np.testing.assert_allclose(got, cur, atol=1e-9)


def test_target_encoding_of_train_rows_is_out_of_fold(spark):
    df = spark.range(400).select("id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("c"),
                                 (F.col("id") % 2).cast("double").alias("y"))
    cfg = PreprocessConfig(numeric_features=[], categorical_features=["c"], categorical_encoding="target")
    fp = fit_pipeline(df, cfg, target="y", keep=["id"])
    # every level occurs once: its own target must not show in the train rows
    assert fp.train.agg(F.count_distinct("c")).first()[0] == 1
    assert fp.train_features().count() == 400


def test_bootstrap_estimates_are_exact(spark):
    from cohortspark.operators import resample
    rng = np.random.default_rng(5)
    e = np.concatenate([rng.exponential(size=400), [1e6]])
    g = ["a" if i % 3 else "b" for i in range(401)]
    df = spark.createDataFrame([(i, g[i], 0.0, float(v)) for i, v in enumerate(e)], "k int, g string, y double, p double")
    out = {(r["group"], r["metric"]): r for r in
           resample.bootstrap_metrics(df, "y", "p", key=["k"], n_resamples=200, by="g").collect()}
    for name, want in (("Overall", e), ("a", e[[x == "a" for x in g]]), ("b", e[[x == "b" for x in g]])):
        r = out[(name, "MedianAE")]
        assert r["estimate"] == pytest.approx(np.median(want), abs=1e-12)
        assert r["ci_lower"] < r["estimate"] < r["ci_upper"] < 2


def test_bootstrap_auc_is_exact(spark):
    from cohortspark.operators import resample
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    p = np.clip(0.5 + 0.0003 * (y - 0.5) + 0.0004 * rng.normal(size=300), 0, 1)  # finer than the bins
    df = spark.createDataFrame([(i, int(a), int(b > 0.5), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "k int, y int, yhat int, p double")
    got = {r["metric"]: r["estimate"] for r in
           resample.bootstrap_metrics(df, "y", "yhat", "classification", "p", ["k"], 50).collect()}
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got["AUC"] == pytest.approx(want, abs=1e-12)


def test_reduce_partials_in_two_steps(spark):
    from cohortspark.functions.aggs import reduce_partials
    rdd = spark.sparkContext.parallelize([("k" if i % 5 else "j", i) for i in range(100)], 25)
    assert reduce_partials(rdd, lambda a, b: a + b) == {"j": sum(range(0, 100, 5)), "k": sum(i for i in range(100) if i % 5)}
