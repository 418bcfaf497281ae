"""F7, F8: regression trees without row sampling see a bounded table of bins, and are those of MLlib on all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models as md

FEATS = ["a", "b", "c"]


def _rows(spark, n):
    def u(k):
        return (F.xxhash64(F.lit(k), "id") % 1000003).cast("double") / 1000003
    df = spark.range(0, n, 1, 4).select("id", u(1).alias("a"), F.floor(u(2) * 20).cast("double").alias("b"),
                                       F.round(u(3) * 3, 1).alias("c"), u(4).alias("e"))
    y = F.col("a") * 3 + F.when(F.col("b") > 4, 2.0).otherwise(0.0) + F.col("c") * F.col("c") + F.col("e")
    return df.withColumn("y", F.when(F.col("id") % 97 != 5, y)).withColumn("a", F.when(F.col("id") % 89 != 7, F.col("a")))


def _plain(df, kind):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    names = {"featuresCol": "__features", "labelCol": "__label", "seed": 42}
    est = RandomForestRegressor(numTrees=5, maxDepth=6, bootstrap=False, featureSubsetStrategy="sqrt", **names) \
        if kind == "extratrees" else GBTRegressor(maxDepth=3, stepSize=0.1, maxIter=6, **names)
    return md.SparkML(kind, FEATS, md._fit(est, md._assemble(df, FEATS, "y")))


@pytest.mark.parametrize("kind, params", [("extratrees", {"n_trees": 5, "max_depth": 6}), ("histgb", {"rounds": 6})])
@pytest.mark.parametrize("n", [900, 24_000])  # thresholds from all rows, from those that MLlib draws
def test_trees_on_bins_are_those_on_rows(spark, monkeypatch, kind, params, n):
    df = _rows(spark, n)
    seen = []
    cells = md._cells

    def counted(*args):
        out = cells(*args)
        seen.append((out[0].agg(F.count(F.lit(1)), F.sum("__weight")).first(), out[1]))
        return out

    monkeypatch.setattr(md, "_cells", counted)
    m = md.fit_model(kind, df, FEATS, "y", "regression", **params)
    (rows, weight), splits = seen[0]
    assert weight == df.where("y is not null and a is not null").count()  # every row counts
    bound = 2
    for s in splits:
        assert len(s) < md.TREE_BINS
        bound *= len(s) + 1
    assert rows <= bound
    got = {r["id"]: r["prediction"] for r in m.transform(df).collect()}  # rows without a value of a feature too
    want = {r["id"]: r["prediction"] for r in _plain(df, kind).transform(df).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_many_bins_stay_on_rows(spark, monkeypatch):
    monkeypatch.setattr(md, "TREE_CELLS", 100)
    df = _rows(spark, 900)
    assert type(md.fit_model("extratrees", df, FEATS, "y", "regression", n_trees=2, max_depth=3)) is md.SparkML


def test_saved_bins_load(spark, tmp_path):
    from cohortspark.sources import saved
    df = _rows(spark, 900)
    m = md.fit_model("histgb", df, FEATS, "y", "regression", rounds=2)
    saved.save(m, str(tmp_path / "m"))
    again = saved.load(str(tmp_path / "m"))
    assert again.transform(df).orderBy("id").collect() == m.transform(df).orderBy("id").collect()
