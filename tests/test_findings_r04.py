"""Finding 1 of round 4: sensitivity_seeds refits the whole forest over all seeds; bootstrap forests from sums per
combination of bins are those of MLlib up to the draws."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models as md
from cohortspark.plans.suite import explain_q
from cohortspark.sources import saved

FEATS = ["a", "b", "c"]


def _rows(spark, n):
    def u(k):
        return (F.xxhash64(F.lit(k), "id") % 1000003).cast("double") / 1000003
    df = spark.range(0, n, 1, 4).select("id", u(1).alias("a"), F.floor(u(2) * 20).cast("double").alias("b"),
                                       F.round(u(3) * 3, 1).alias("c"), u(4).alias("e"))
    y = F.col("a") * 3 + F.when(F.col("b") > 4, 2.0).otherwise(0.0) + F.col("c") * F.col("c") + F.col("e")
    return df.withColumn("y", F.when(F.col("id") % 97 != 5, y)).withColumn("a", F.when(F.col("id") % 89 != 7, F.col("a")))


def test_seeds_refit_the_whole_forest(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, 1, *map(float, (rng.integers(1, 51), rng.integers(0, 11) / 100, rng.integers(0, 9) / 100, rng.uniform(900, 1e5))))
            for i in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                                "l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    fits, scored = [], []
    fit, score = md.fit_forest, md.score_model

    def fitted(*args, **kwargs):
        bound = inspect.signature(fit).bind(*args, **kwargs)
        bound.apply_defaults()
        a = bound.arguments
        fits.append((a["seed"], a["n_trees"], a["max_depth"], a["min_leaf"], a["bootstrap"], a["df"].count()))
        return fit(*args, **kwargs)

    def evaluated(*args):
        scored.append(score(*args))
        return scored[-1]

    monkeypatch.setattr(md, "fit_forest", fitted)
    monkeypatch.setattr(md, "score_model", evaluated)
    got = explain_q.q_seeds(spark, str(tmp_path)).collect()
    seeds = (42, 0, 1, 7, 13, 99, 123, 456)
    assert [f[:5] for f in fits] == [(s, 100, 30, 1, True) for s in seeds]
    assert {f[5] + m["n"] for f, m in zip(fits, scored)} == {600}
    rmse = np.array([m["rmse"] for m in scored[1:]])
    assert len(got) == 1 and got[0]["mean"] == pytest.approx(rmse.mean()) and got[0]["sd"] == pytest.approx(rmse.std())
    assert got[0]["range"] == pytest.approx(np.ptp(rmse)) and len(set(rmse)) == 7


@pytest.mark.parametrize("max_depth, min_leaf", [(30, 1), (3, 1), (30, 25)])
def test_tree_is_that_of_mllib(spark, monkeypatch, max_depth, min_leaf):
    """Each row drawn once, all features tried at each node: nothing random is left."""
    from pyspark.ml.regression import RandomForestRegressor
    monkeypatch.setattr("cohortspark.operators.resample.poisson_weights", lambda h, b: np.ones((len(h), b), dtype=np.uint8))
    df = _rows(spark, 3000)
    rows = md._tree_rows(df, FEATS, "y")
    splits = md._tree_bins(rows, 3, 42)
    parts = list(md._bag_sums(splits, range(1), 2.5)([rows.withColumn("__h", F.lit(0)).toPandas()]))
    n, s = np.frombuffer(parts[0]["n"][0]), np.frombuffer(parts[0]["s"][0])
    assert n.sum() == rows.count()
    rows.unpersist()
    values = 2.5 + md._grow(n, s, [len(t) + 1 for t in splits], 3, max_depth, min_leaf, np.random.default_rng(1))
    known = [r["id"] for r in df.where("y is not null and a is not null").collect()]
    got = {r["id"]: r["prediction"] for r in md.CellForest("rf", FEATS, splits, values).transform(df).collect()}
    est = RandomForestRegressor(featuresCol="__features", labelCol="__label", numTrees=1, maxDepth=max_depth, bootstrap=False,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy="all", seed=42)
    plain = md.SparkML("rf", FEATS, md._fit(est, md._assemble(df, FEATS, "y")))
    want = {r["id"]: r["prediction"] for r in plain.transform(df).collect()}  # rows without a value of a feature too
    assert [got[i] for i in known] == pytest.approx([want[i] for i in known], rel=1e-9)
    # splits of equal gain part the same training rows; which of them is taken hangs on the last digits of their sums
    assert sum(abs(got[i] - want[i]) > 1e-9 for i in want) <= 3 * (max_depth == 30 and min_leaf == 1)


def test_rows_are_drawn_one_by_one(spark):
    """Equal rows have draws of their own, and so have trees, also those summed in another pass."""
    df = spark.range(0, 20_000, 1, 4).select(F.lit(1.0).alias("x0"), F.lit(3.0).alias("__label"))
    sums = []
    for at in (0, 40):
        drawn = df.withColumn("__h", F.xxhash64(F.lit(5), F.lit(at), F.monotonically_increasing_id())).toPandas()
        found = list(md._bag_sums([[]], range(at, at + 40), 1.0)([drawn[:7_000], drawn[7_000:]]))
        assert [int(p["tree"][0]) for p in found] == list(range(at, at + 40))
        n = np.array([np.frombuffer(p["n"][0])[0] for p in found])
        np.testing.assert_allclose([np.frombuffer(p["s"][0])[0] for p in found], 2 * n)
        sums += list(n)
    assert abs(np.mean(sums) - 20_000) < 100 and 80 < np.std(sums) < 220 and len(set(sums)) > 40


@pytest.mark.parametrize("passes", [1, 3])
def test_forest_on_sums_predicts_as_mllibs(spark, monkeypatch, passes):
    df = _rows(spark, 4000)
    train, test = df.where("id < 3000"), df.where("id >= 3000 and y is not null")
    if passes > 1:
        monkeypatch.setattr(md, "BAG_CELLS", 32 * 20 * 32 * 7)
    ours = md.fit_forest(train, FEATS, "y", n_trees=20, max_depth=10, seed=3, cells=True)
    theirs = md.fit_forest(train, FEATS, "y", n_trees=20, max_depth=10, seed=3)
    assert type(ours) is md.CellForest and type(theirs) is md.SparkML
    a, b = (np.array([r["prediction"] for r in m.transform(test).orderBy("id").collect()]) for m in (ours, theirs))
    y = np.array([r["y"] for r in test.orderBy("id").collect()])
    rmse_a, rmse_b = (float(np.sqrt(((p - y) ** 2).mean())) for p in (a, b))
    assert np.corrcoef(a, b)[0, 1] > 0.98 and rmse_a == pytest.approx(rmse_b, rel=0.15)
    other = md.fit_forest(train, FEATS, "y", n_trees=20, max_depth=10, seed=4, cells=True)
    assert not np.array_equal(ours.values, other.values)


def test_forest_on_sums_saved_and_bounded(spark, tmp_path, monkeypatch):
    df = _rows(spark, 500).withColumn("k", F.lit(1.0))
    m = md.fit_forest(df, [*FEATS, "k"], "y", n_trees=3, cells=True)  # a feature with one value
    saved.save(m, str(tmp_path / "m"))
    assert saved.load(str(tmp_path / "m")).transform(df).orderBy("id").collect() == m.transform(df).orderBy("id").collect()
    monkeypatch.setattr(md, "TREE_CELLS", 100)
    assert type(md.fit_forest(df, FEATS, "y", n_trees=2, max_depth=3, cells=True)) is md.SparkML
