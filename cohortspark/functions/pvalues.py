"""Vectorised p-value columns (pandas UDFs over small statistic tables).

Statistics come out of Spark aggregations as one row per test / feature /
group; the CDF is applied batch-wise with Arrow, never row-at-a-time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions import dist


def _apply(fn, *series):
    out = []
    for vals in zip(*series):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
            out.append(None)
        else:
            out.append(float(fn(*vals)))
    return pd.Series(out, dtype="object").astype("float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t p-value."""
    return _apply(dist.t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(dist.f_sf, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(dist.chi2_sf, x, df)


@F.pandas_udf(T.DoubleType())
def norm_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return _apply(lambda v: min(1.0, 2.0 * dist.norm_sf(abs(v))), z)


@F.pandas_udf(T.DoubleType())
def fisher_pvalue(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _apply(lambda *v: dist.fisher_exact_2x2(*[int(x) for x in v])[1], a, b, c, d)


@F.pandas_udf(T.DoubleType())
def mwu_exact_pvalue(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    def fn(uu, a, b):
        a, b = int(a), int(b)
        big = max(uu, a * b - uu)
        return min(1.0, 2.0 * dist.mann_whitney_exact_sf(big, a, b))
    return _apply(fn, u, n1, n2)


@F.pandas_udf(T.DoubleType())
def wilcoxon_exact_pvalue(t: pd.Series, n: pd.Series) -> pd.Series:
    return _apply(lambda tt, nn: min(1.0, 2.0 * dist.wilcoxon_exact_cdf(tt, int(nn))), t, n)
