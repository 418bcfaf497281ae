"""Round trips of fitted models, steps and pipelines."""

import numpy as np
import pandas as pd
import pytest

from cohortspark.operators import models as md
from cohortspark.operators import preprocess as pp
from cohortspark.plans.pipeline import PreprocessConfig, fit_pipeline
from cohortspark.sources import io, saved


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(6)
    n = 800
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n) * 50 + 100,
                        "c": rng.choice(["x", "y", "z"], n), "y": rng.integers(0, 3, n).astype(float)})
    pdf["a"] += pdf["y"]
    pdf["name"] = pdf["y"].map({0.0: "low", 1.0: "mid", 2.0: "high"})
    pdf.loc[::31, "b"] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, name string").repartition(3)


def same(one, two, df):
    x, y = (t.transform(df).orderBy("id").toPandas() for t in (one, two))
    pd.testing.assert_frame_equal(x, y)


@pytest.mark.parametrize("fit", [
    lambda d: md.fit_lda(d, ["a", "b"], "y"), lambda d: md.fit_lda(d, ["a", "b"], "name"),
    lambda d: md.fit_knn(d, ["a", "b"], "y", 3), lambda d: md.fit_rbf_svm(d, ["a", "b"], "y", n_components=5),
    lambda d: md.fit_ols(d, ["a", "b"], "y"), lambda d: md.fit_mean(d, ["a"], "y")],
    ids=["lda", "lda-text", "knn", "fourier", "ols", "mean"])
def test_models(df, tmp_path, monkeypatch, fit):
    monkeypatch.setattr(saved, "INLINE", 100)
    whole = df.dropna()
    model = fit(whole)
    io.save_model(model, str(tmp_path / "m"))
    back = io.load_model(str(tmp_path / "m"))
    assert type(back) is type(model)
    same(model, back, whole)


def test_text_classes(df):
    got = md.fit_lda(df.dropna(), ["a", "b"], "name").transform(df.dropna())
    assert {r[0] for r in got.select("prediction").distinct().collect()} <= {"low", "mid", "high"}


@pytest.mark.parametrize("encoding", ["onehot", "ordinal", "target"])
def test_pipeline_on_batches_and_streams(spark, df, tmp_path, monkeypatch, encoding):
    monkeypatch.setattr(pp, "INLINE_LEVELS", 2)  # the categories go through a level table
    cfg = PreprocessConfig(numeric_features=["a", "b"], categorical_features=["c"], numeric_missing_indicators=True,
                           numeric_outlier_treatment="percentile", numeric_scaling="standard",
                           categorical_encoding=encoding, unit_factors={"b": 2.0}, plausibility_bounds={"a": (-9.0, 9.0)})
    fitted = fit_pipeline(df, cfg, "y", keep=["id"])
    saved.save(fitted, str(tmp_path / "p"))
    back = saved.load(str(tmp_path / "p"))
    same(fitted, back, df)
    if encoding == "ordinal":
        df.write.parquet(str(tmp_path / "in"))
        stream = back.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def test_refuses_what_it_cannot_keep(df, tmp_path):
    with pytest.raises(TypeError):
        saved.save(lambda d: d, str(tmp_path / "f"))
