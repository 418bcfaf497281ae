"""Bootstrap: metric objects, failing metrics, the BCa formula and intervals against a multinomial bootstrap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import resample as rs
from cohortspark.operators.resample import Metric


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 4000
    y = rng.normal(10, 4, n)
    return pd.DataFrame({"k": np.arange(n), "y": y, "p": y + rng.gamma(1.0, 1.0, n) * rng.choice([-1, 1], n),
                         "g": np.where(rng.random(n) < 0.4, "a", np.where(rng.random(n) < 0.998, "b", "c"))})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


def test_weights_are_poisson():
    w = rs.poisson_weights(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64), 302)
    assert w.shape == (3000, 302)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs((w == 0).mean() - np.exp(-1)) < 0.003


def numpy_interval(frame, fn, n_rep=2000):
    rng = np.random.default_rng(9)
    y, p = frame["y"].to_numpy(), frame["p"].to_numpy()
    draws = [rng.integers(0, len(y), len(y)) for _ in range(n_rep)]
    return np.quantile([fn(y[i], p[i]) for i in draws], [0.025, 0.975])


def test_default_metrics_match_a_plain_bootstrap(df, frame):
    got = {r["metric"]: r for r in rs.bootstrap_metrics(df, "y", "p", key=["k"]).collect()}
    fns = {"MAE": lambda y, p: np.abs(y - p).mean(), "RMSE": lambda y, p: np.sqrt(((y - p) ** 2).mean()),
           "MedianAE": lambda y, p: np.median(np.abs(y - p)),
           "R2": lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()}
    assert set(got) == set(fns)
    for name, fn in fns.items():
        r = got[name]
        assert r["n"] == len(frame) and r["n_resamples"] == 1000
        assert r["estimate"] == pytest.approx(fn(frame["y"], frame["p"]), rel=1e-9)
        lo, hi = numpy_interval(frame, fn)
        assert r["ci_lower"] == pytest.approx(lo, abs=0.2 * (hi - lo)) and r["ci_upper"] == pytest.approx(hi, abs=0.2 * (hi - lo))


def test_user_metric_and_failing_metric(df, frame):
    def broken(n, s):
        raise ZeroDivisionError("no such value")

    bias = Metric("Bias", lambda y, p, s: [p - y], lambda n, d: d / n)
    got = {(r["group"], r["metric"]): r for r in rs.bootstrap_metrics(
        df, "y", "p", key=["k"], n_resamples=400, by="g",
        metrics_=[bias, Metric("Broken", lambda y, p, s: [y], broken)]).collect()}
    assert {g for g, _ in got} == {"a", "b", "Overall"} | ({"c"} if (frame["g"] == "c").sum() >= 5 else set())
    for g in ("a", "b", "Overall"):
        part = frame if g == "Overall" else frame[frame["g"] == g]
        want = (part["p"] - part["y"]).mean()
        half = 1.96 * (part["p"] - part["y"]).std() / np.sqrt(len(part))
        r = got[(g, "Bias")]
        assert r["n"] == len(part) and r["estimate"] == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert r["ci_lower"] == pytest.approx(want - half, abs=0.5 * half) and r["ci_upper"] == pytest.approx(want + half, abs=0.5 * half)
        assert all(np.isnan(got[(g, "Broken")][c]) for c in ("estimate", "ci_lower", "ci_upper"))


def test_bca_limits():
    rng = np.random.default_rng(2)
    boot = rng.normal(0, 1, (20_000, 2))
    flat = np.zeros((50, 2))
    lo, hi = rs.bca_intervals(np.zeros(2), boot, flat)
    np.testing.assert_allclose([lo, hi], np.quantile(boot, [0.025, 0.975], axis=0), atol=0.08)
    # an estimate above the replicates' median moves both limits up
    lo2, hi2 = rs.bca_intervals(np.full(2, 0.3), boot, flat)
    assert (lo2 > lo).all() and (hi2 > hi).all()
    # acceleration: z0 = 0 gives level = Phi(z / (1 - a z))
    jack = rng.gamma(1.0, 1.0, (50, 1))
    d = jack.mean() - jack
    a = (d ** 3).sum() / (6 * (d ** 2).sum() ** 1.5)
    got = rs.bca_intervals(np.array([np.median(boot[:, 0])]), boot[:, :1], jack)
    from statistics import NormalDist
    n = NormalDist()
    want = [np.quantile(boot[:, 0], n.cdf(z / (1 - a * z))) for z in (n.inv_cdf(0.025), n.inv_cdf(0.975))]
    np.testing.assert_allclose(np.ravel(got), want, atol=0.02)
    none = rs.bca_intervals(np.array([1.0]), np.full((10, 1), np.nan), np.full((5, 1), np.nan))
    assert np.isnan(none).all()


def test_classes(spark):
    rng = np.random.default_rng(3)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    s = 1 / (1 + np.exp(-(rng.normal(0, 1, n) + 1.5 * y - 1)))
    pdf = pd.DataFrame({"k": np.arange(n), "y": y, "s": s, "p": (s > 0.5).astype(int)})
    rows = rs.bootstrap_metrics(spark.createDataFrame(pdf), "y", "p", "classification", "s", ["k"], 500).collect()
    got = {r["metric"]: r for r in rows}
    order = pdf["s"].rank().to_numpy()
    pos, neg = y.sum(), n - y.sum()
    want = {"Accuracy": (pdf.y == pdf.p).mean(), "Brier": ((s - y) ** 2).mean(),
            "AUC": (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)}
    assert set(got) == set(want) | {"F1"}
    for name, v in want.items():
        assert got[name]["estimate"] == pytest.approx(v, rel=1e-9)
        assert got[name]["ci_lower"] < v < got[name]["ci_upper"]
    assert 0.01 < got["AUC"]["ci_upper"] - got["AUC"]["ci_lower"] < 0.06
