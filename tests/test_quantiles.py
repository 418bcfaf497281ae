"""Selection of quantiles and modes, distinct counts: against pandas, with hot values, groups and narrow brackets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import quantiles as Q
from cohortspark.functions.aggs import distinct_counts


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 12_000
    x = rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n)
    hot = np.where(rng.random(n) < 0.9, 5.0, rng.integers(0, 50, n))
    g = np.where(rng.random(n) < 0.34, "hot", np.char.add("g", rng.integers(0, 40, n).astype(str)))
    pdf = pd.DataFrame({"x": x, "hot": hot, "few": rng.integers(0, 3, n).astype(float), "g": g})
    pdf.loc[::17, "x"] = np.nan
    pdf.loc[pdf.index[::23], "g"] = None
    pdf["none"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "x double, hot double, few double, g string, none double").repartition(6)


PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("band,bins,groups", [(100_000, 4096, 1000), (20, 8, 3)])
def test_quantiles(df, frame, monkeypatch, band, bins, groups):
    monkeypatch.setattr(Q, "BAND", band)
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "DRIVER_GROUPS", groups)
    got = Q.exact_quantiles(df, ["x", "hot", "few", "none"], PROBS)
    for c in ("x", "hot", "few"):
        np.testing.assert_allclose(got[c], frame[c].quantile(PROBS), rtol=1e-12)
    assert got["none"] == [None] * len(PROBS)
    rows = Q.group_quantiles(df, {c: F.col(c) for c in ("x", "hot", "none")}, PROBS, {"g": F.col("g")}).collect()
    want = {("\0" if g is None or g != g else g): d for g, d in frame.groupby("g", dropna=False)}
    assert len(rows) == 3 * len(want)
    for r in rows:
        d = want["\0" if r["g"] is None else r["g"]]
        assert r["n"] == d[r["column"]].count()
        if r["n"]:
            np.testing.assert_allclose(r["q"], d[r["column"]].quantile(PROBS), rtol=1e-12)
        else:
            assert r["q"] is None


def test_extreme_values(spark):
    big = [(v,) for v in (-1.7e308, 1.7e308, 0.0, 5e-324)] * 600
    df = spark.createDataFrame(big, "v double")
    got = Q.exact_quantiles(df, ["v"], [0.0, 0.2, 0.4, 0.6, 1.0])["v"]
    assert got == [-1.7e308, -1.7e308, 0.0, 5e-324, 1.7e308]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, g string")
    assert Q.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    assert Q.group_quantiles(df, {"a": F.col("a")}, [0.5], {"g": F.col("g")}).count() == 0
    assert Q.modes(df, {"a": F.col("a"), "g": F.col("g")}) == {"a": None, "g": None}


def test_no_whole_column_buffer(df):
    plan = Q.group_quantiles(df, {"x": F.col("x")}, [0.5], {"g": F.col("g")})._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "mode(" not in plan


def test_modes(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, None), ("a", 2, None), ("b", 1, None), (None, 9, None)],
                               "s string, i int, e date")
    assert Q.modes(df, {c: F.col(c) for c in df.columns}) == {"s": "a", "i": 1, "e": None}


def test_distinct_counts(spark):
    df = spark.sql("""select * from values (1, 'a', 1.5d, true, date'2020-01-01', 1.10, array(1), X'00'),
        (1, 'b', 0.0d, false, date'2020-01-01', 1.1, array(2), X'01'), (null, 'a', -0.0d, null, null, null, null, null),
        (2, null, double('NaN'), true, date'2021-01-01', 2.0, array(1), X'00') as t(i, s, d, b, dt, dec, arr, bin)""")
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    assert distinct_counts(df, df.columns) == want
