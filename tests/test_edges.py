"""Edge cases the driver tables do not contain: NaN vs NULL, constant and
all-null columns, ties, tiny groups, one class, NULL join keys, bin edges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.columns import make_unique_columns, normalize_missing
from cohortspark.operators import audit, calibrate, htest, metrics, outliers, preprocess, profile, table1
from cohortspark.plans.merge import merge


def test_unique_names():
    assert make_unique_columns(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    out = normalize_missing(df)
    assert out.where(F.col("x").isNull()).count() == 2


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (1, None, "c")], "k int, z double, s string")
    card = {r["column"]: r for r in audit.cardinality_table(df).collect()}
    assert card["k"]["cardinality"] == "Constant"
    assert card["z"]["n_unique"] == 0
    assert audit.drop_constant_columns(df).columns == ["z", "s"]
    miss = audit.missing_table(df).collect()
    assert [(r["column"], r["missing_count"]) for r in miss] == [("z", 3)]


def test_iqr_outliers_small_vector(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "x double")
    s = outliers.outlier_summary(df, ["x"], "iqr").first()
    assert s["outlier_count"] == 1
    # fewer than 3 values -> no bounds, nothing flagged
    tiny = spark.createDataFrame([(1.0,), (50.0,)], "x double")
    assert outliers.outlier_summary(tiny, ["x"], "iqr").first()["outlier_count"] == 0


def test_zero_spread_disables_rules(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "x double")
    for m in ("iqr", "mad", "zscore"):
        assert outliers.outlier_summary(df, ["x"], m).first()["outlier_count"] == 0


def test_capping_matrix(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(range(1, 6), range(10, 60, 10))], "a double, b double")
    clip = preprocess.fit_outlier_capping(df, ["a", "b"], "percentile", {"lower_q": 0.1, "upper_q": 0.9})
    rows = clip.transform(df).collect()
    assert min(r["a"] for r in rows) == pytest.approx(np.percentile([1, 2, 3, 4, 5], 10))
    assert max(r["b"] for r in rows) == pytest.approx(np.percentile([10, 20, 30, 40, 50], 90))


def test_null_keys_match_in_merge(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, va string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, vb string")
    got = sorted(merge(a, b, on="k", how="outer").collect(), key=lambda r: (r["k"] is not None, r["k"] or 0))
    assert [(r["k"], r["va"], r["vb"]) for r in got] == [(None, "x", "p"), (1, "y", None), (2, None, "q")]


def test_overlapping_names_get_suffixes(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y")], "k int, v string")
    assert merge(a, b, on="k").columns == ["k", "v_x", "v_y"]


def test_single_class_profile(spark):
    df = spark.createDataFrame([(1,)] * 20, "y int")
    t = profile.target_profile_classes(df, "y").first()
    assert t["n_classes"] == 1 and t["class_balance_ratio"] == 1.0


def test_reliability_bin_edges(spark):
    ps = [0.0, 0.3, 0.6, 0.7, 1.0]
    df = spark.createDataFrame([(1.0, p) for p in ps], "y double, p double")
    got = {r["bin"]: r["count"] for r in calibrate.reliability_bins(df, "y", "p").collect()}
    edges = np.linspace(0, 1, 11)
    exp = {}
    for p in ps:
        b = 9 if p == 1.0 else int(np.searchsorted(edges, p, side="right") - 1)
        exp[b] = exp.get(b, 0) + 1
    assert got == exp


def test_regression_calibration_exact(spark):
    rng = np.random.default_rng(42)
    y = rng.normal(100, 20, 200)
    df = spark.createDataFrame([(float(a), float(0.9 * a + 5)) for a in y], "y double, p double")
    r = calibrate.calibration_regression(df, "y", "p").first()
    assert r["calibration_slope"] == pytest.approx(1 / 0.9)
    assert r["calibration_intercept"] == pytest.approx(-5 / 0.9)


def test_evaluation_vectors(spark):
    df = spark.createDataFrame([(float(a), b) for a, b in zip([1, 2, 3, 4, 5], [1.1, 2.1, 2.9, 4.2, 4.7])], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    e = np.array([1, 2, 3, 4, 5]) - np.array([1.1, 2.1, 2.9, 4.2, 4.7])
    assert m["mae"] == pytest.approx(np.abs(e).mean())
    assert m["median_ae"] == pytest.approx(np.median(np.abs(e)))
    c = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 0])), "y int, p int")
    acc = metrics.accuracy_f1(c, "y", "p").first()
    assert acc["accuracy"] == pytest.approx(0.6)


def test_auc_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.875)


def test_chi_square_zero_cell_uses_fisher_in_table1(spark):
    rows = [("a", "x")] * 6 + [("a", "y")] * 3 + [("b", "x")] * 4
    df = spark.createDataFrame(rows, "g string, c string")
    cfg = table1.Table1Config(grouping_var="g", categorical_vars=["c"])
    _cells, tests = table1.generate_table1(df, cfg)
    assert tests.first()["test"] == "Fisher exact"


def test_table1_empty_variable_list(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    cells, tests = table1.generate_table1(df, table1.Table1Config())
    assert cells.count() == 0 and tests.count() == 0


def test_small_groups_t_test_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    r = htest.two_sample_test(df, "v", "g", "a", "b", parametric=True).first()
    assert r["statistic"] is None or math.isnan(r["statistic"])


def test_number_like_strings_flag_mixed(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",)], "s string")
    assert audit.type_validity_table(df).first()["mixed_types"] is True


def test_unseen_category_at_apply_time(spark):
    tr = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    te = spark.createDataFrame([("z",)], "c string")
    oh = preprocess.fit_one_hot(tr, ["c"]).transform(te).first()
    assert all(v == 0.0 for v in oh.asDict().values())
    assert preprocess.fit_ordinal(tr, ["c"]).transform(te).first()["c"] == -1.0


def test_dataset_profile_rejects_empty(spark):
    df = spark.createDataFrame([], "x double, y double")
    with pytest.raises(ValueError):
        profile.dataset_profile(df, "y")
