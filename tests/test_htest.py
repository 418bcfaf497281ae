"""Tests against brute-force numpy/pandas on small fixtures with ties and NULLs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from cohortspark.operators import htest, ranks

RNG = np.random.default_rng(42)


def _df(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


def test_average_rank_with_ties(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 3.0, 3.0, None, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    got = {r["i"]: r["rank"] for r in ranks.average_rank(df, "v", "rank").collect()}
    exp = pd.Series(vals).rank(method="average")
    for i, v in enumerate(vals):
        if v is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(exp[i])


def test_ranks_partition_invariant(spark):
    x = RNG.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    a = sorted((r["v"], r["avg_rank"]) for r in ranks.value_positions(df.repartition(1), "v").collect())
    b = sorted((r["v"], r["avg_rank"]) for r in ranks.value_positions(df.repartition(7), "v", buckets=5).collect())
    assert a == b


def _kendall_brute(x, y):
    n = len(x)
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(n), 2):
        s = (x[i] - x[j]) * (y[i] - y[j])
        if s > 0:
            c += 1
        elif s < 0:
            d += 1
        elif x[i] == x[j] and y[i] != y[j]:
            tx += 1
        elif y[i] == y[j] and x[i] != x[j]:
            ty += 1
    return (c - d) / math.sqrt((c + d + tx) * (c + d + ty)), d


def test_kendall_matches_brute_force(spark):
    x = RNG.integers(0, 30, 400).astype(float)
    y = (x + RNG.integers(0, 20, 400)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    tau_b, d = _kendall_brute(x, y)
    k = htest.kendall_tau(df, "x", "y")
    assert k["discordant"] == d
    assert k["tau"] == pytest.approx(tau_b, rel=1e-9)
    assert 0 <= k["p_value"] <= 1


def test_kendall_exact_small(spark):
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 6])], "x double, y double")
    k = htest.kendall_tau(df, "x", "y")
    assert k["tau"] == pytest.approx(11 / 15)


def test_spearman_pearson(spark):
    x = RNG.normal(size=300).round(1)
    y = (x + RNG.normal(size=300)).round(1)
    pdf = pd.DataFrame({"x": x, "y": y})
    pdf.loc[5, "x"] = np.nan
    df = _df(spark, pdf)
    c = pdf.dropna()
    sp = htest.correlation_test(df, "x", "y", "spearman").first()
    assert sp["r"] == pytest.approx(c["x"].rank().corr(c["y"].rank()), rel=1e-9)
    pe = htest.correlation_test(df, "x", "y", "pearson").first()
    assert pe["r"] == pytest.approx(c["x"].corr(c["y"]), rel=1e-9)
    assert pe["n"] == 299


def test_mann_whitney_and_kruskal(spark):
    g = np.array(["a"] * 40 + ["b"] * 35 + ["c"] * 25)
    v = RNG.integers(0, 15, 100).astype(float)
    pdf = pd.DataFrame({"g": g, "v": v})
    df = _df(spark, pdf)
    two = pdf[pdf.g.isin(["a", "b"])]
    rk = two.v.rank()
    u1 = rk[two.g == "a"].sum() - 40 * 41 / 2
    res = htest.two_sample_test(df, "v", "g", "a", "b", parametric=False).first()
    assert res["statistic"] == pytest.approx(u1)
    assert 0 < res["p_value"] <= 1
    rk_all = pdf.v.rank()
    n = len(pdf)
    t = pdf.v.value_counts()
    h = (12 / (n * (n + 1)) * sum(rk_all[pdf.g == k].sum() ** 2 / (pdf.g == k).sum() for k in "abc") - 3 * (n + 1))
    h /= 1 - ((t ** 3 - t).sum()) / (n ** 3 - n)
    kw = htest.k_sample_test(df, "v", "g", parametric=False).first()
    assert kw["statistic"] == pytest.approx(h, rel=1e-9)


def test_mann_whitney_exact_small(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    res = htest.two_sample_test(df, "v", "g", "a", "b", parametric=False).first()
    assert res["statistic"] == 0.0
    assert res["p_value"] == pytest.approx(0.1)  # 2 / C(6,3)


def test_wilcoxon_zero_and_ties(spark):
    d = [0.1, -0.1, 0.2, 0.0, -0.1]
    df = spark.createDataFrame([(0.0, v) for v in d], "a double, b double")
    res = htest.paired_test(df, "a", "b", parametric=False).first()
    nz = pd.Series([v for v in d if v != 0])
    r = nz.abs().rank()
    assert res["n"] == 4
    assert res["statistic"] == pytest.approx(min(r[nz > 0].sum(), r[nz < 0].sum()))


def test_chi_square_yates_and_fisher(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 15 + [("y", "q")] * 25
    df = spark.createDataFrame(rows, "a string, b string")
    obs = np.array([[10, 20], [15, 25]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    diff = e - obs
    o2 = obs + np.minimum(0.5, np.abs(diff)) * np.sign(diff)
    chi = ((o2 - e) ** 2 / e).sum()
    res = htest.chi_square_test(df, "a", "b").first()
    assert res["statistic"] == pytest.approx(chi)
    f = htest.fisher_test(df, "a", "b").first()
    assert f["statistic"] == pytest.approx(10 * 25 / (20 * 15))


def test_friedman_against_formula(spark):
    data = RNG.integers(0, 5, (12, 4)).astype(float)
    rows = [(i, j, float(data[i, j])) for i in range(12) for j in range(4)]
    df = spark.createDataFrame(rows, "blk long, trt long, v double")
    rk = pd.DataFrame(data).rank(axis=1)
    n, k = data.shape
    ties = sum(((c ** 3 - c).sum()) for c in (pd.Series(r).value_counts() for r in data))
    chisq = (12 / (n * k * (k + 1)) * (rk.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (k * (k * k - 1) * n))
    res = htest.friedman_test(df, "blk", "trt", "v").first()
    assert res["statistic"] == pytest.approx(chisq, rel=1e-9)


def test_p_adjust(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "feature string, p_value double")
    got = {r["feature"]: r["p_fdr_bh"] for r in htest.p_adjust(df).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.0533333333, "c": 0.0533333333, "d": 0.2})
