"""Outlier rules (ops 60-64): IQR, MAD, z-score and percentile bounds.

Bounds are O(columns) scalars from one fused aggregation (MAD needs a second
pass for the median of absolute deviations); flags are plain Column
expressions, so counting or filtering stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import collect_scalars, scalar_quantiles, unpivot_stats
from cohortspark.functions.columns import numeric_cols, q
from cohortspark.functions.quantiles import column_quantiles

METHODS = ("iqr", "mad", "zscore", "percentile")


@dataclass(frozen=True)
class Bounds:
    method: str
    n: int
    lower: float | None = None
    upper: float | None = None
    center: float | None = None      # median (mad) / mean (zscore)
    scale: float | None = None       # MAD / sd
    threshold: float | None = None

    @property
    def active(self) -> bool:
        return self.lower is not None


def fit_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr",
               params: dict | None = None, quantile_method: str = "exact") -> dict[str, Bounds]:
    """Per-column outlier bounds; inactive when n < 3 or the spread is 0."""
    params = params or {}
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method}")
    x = lambda c: c.cast("double")
    stats = {"n": lambda c: F.count(c)}
    if method == "zscore":
        stats["mean"] = lambda c: F.avg(x(c))
        stats["sd"] = lambda c: F.stddev_samp(x(c))
    vals = collect_scalars(df, cols, stats)
    probs = {"iqr": [0.25, 0.75], "mad": [0.5], "zscore": [],
             "percentile": [float(params.get("lower_q", 0.01)), float(params.get("upper_q", 0.99))]}[method]
    qs = scalar_quantiles(df, cols, probs, quantile_method) if probs else {}
    mads: dict[str, float | None] = {}
    if method == "mad":
        dev = {c: F.abs(x(q(c)) - F.lit(qs[c][0])) for c in cols if qs[c][0] is not None}
        if quantile_method == "approx":
            rows = df.select(*[e.alias(c) for c, e in dev.items()])
            mads = {c: v[0] for c, v in scalar_quantiles(rows, list(dev), [0.5], "approx").items()}
        else:
            mads = {c: v[0] for c, v in column_quantiles(df, dev, [0.5]).items()}
    out: dict[str, Bounds] = {}
    thr_mad = float(params.get("threshold", 3.5))
    thr_z = float(params.get("threshold", 3.0))
    for c in cols:
        v = vals[c]
        n = int(v["n"] or 0)
        if n < 3:
            out[c] = Bounds(method, n)
            continue
        if method in ("iqr", "percentile"):
            a, b = qs[c]
            if method == "iqr":
                iqr = b - a
                if iqr == 0:
                    out[c] = Bounds(method, n)
                    continue
                out[c] = Bounds(method, n, a - 1.5 * iqr, b + 1.5 * iqr)
            else:
                out[c] = Bounds(method, n, a, b)
        elif method == "zscore":
            sd = v["sd"]
            if not sd:
                out[c] = Bounds(method, n)
                continue
            out[c] = Bounds(method, n, v["mean"] - thr_z * sd, v["mean"] + thr_z * sd,
                            v["mean"], sd, thr_z)
        else:
            med, mad = qs[c][0], mads.get(c)
            if not mad:
                out[c] = Bounds(method, n)
                continue
            s = 1.4826 * mad
            out[c] = Bounds(method, n, med - thr_mad * s, med + thr_mad * s, med, mad, thr_mad)
    return out


def flag_expr(col: str, b: Bounds) -> Column:
    """True where the value is an outlier; NULL stays False."""
    if not b.active:
        return F.lit(False)
    x = q(col).cast("double")
    if b.method == "mad":
        flag = F.abs(F.lit(0.6745) * (x - F.lit(b.center)) / F.lit(b.scale)) > F.lit(b.threshold)
    elif b.method == "zscore":
        flag = F.abs((x - F.lit(b.center)) / F.lit(b.scale)) > F.lit(b.threshold)
    else:
        flag = (x < F.lit(b.lower)) | (x > F.lit(b.upper))
    return F.coalesce(flag, F.lit(False))


def flag_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                  params: dict | None = None, suffix: str = "_outlier") -> DataFrame:
    """Append one boolean flag column per checked column (op 60-63)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    bounds = fit_bounds(df, cols, method, params)
    return df.select("*", *[flag_expr(c, bounds[c]).alias(f"{c}{suffix}") for c in cols])


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                    params: dict | None = None) -> DataFrame:
    """Per column: n, bounds, outlier count and rate among non-null values (op 64)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    bounds = fit_bounds(df, cols, method, params)
    row = df.agg(*[F.sum(flag_expr(c, bounds[c]).cast("long")).alias(f"c{i}__k")
                   for i, c in enumerate(cols)])
    long = unpivot_stats(row, cols, ["k"])

    def cmap(attr):
        return F.create_map(*[x for c in cols for x in
                              (F.lit(c), F.lit(getattr(bounds[c], attr)).cast("double"))])
    n_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(bounds[c].n).cast("long"))])
    n = n_map[F.col("column")]
    k = F.coalesce(F.col("k"), F.lit(0)).cast("long")
    return long.select(
        "column", F.lit(method).alias("method"), n.alias("n"),
        cmap("lower")[F.col("column")].alias("lower"), cmap("upper")[F.col("column")].alias("upper"),
        k.alias("outlier_count"),
        F.when(n > 0, k / n).otherwise(0.0).alias("outlier_rate"))


def outlier_rate(df: DataFrame, col: str, method: str = "iqr", params: dict | None = None) -> float:
    """Share of non-null values flagged (driver scalar)."""
    return outlier_summary(df, [col], method, params).first()["outlier_rate"]


def outlier_influence(df: DataFrame, target: str, method: str = "iqr", min_n: int = 10) -> DataFrame:
    """Regression-target outlier share and bounds (op 64 action); empty below min_n."""
    s = outlier_summary(df, [target], method)
    return s.where(F.col("n") >= min_n)
