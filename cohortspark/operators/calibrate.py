"""Calibration and decision curves (ops 162-167)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import q


def _yp(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(q(y).cast("double").alias("y"), q(p).cast("double").alias("p")).dropna()


def brier_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return _yp(df, y, p).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def reliability_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins on the literal edges linspace(0, 1, n_bins + 1):
    [lo, hi) except the last, which is closed.  (floor(p * 10) would put .3,
    .6 and .7 in different bins than those edges do.)"""
    edges = [float(e) for e in np.linspace(0, 1, n_bins + 1)]
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    t = _yp(df, y, p).where((F.col("p") >= 0) & (F.col("p") <= 1))
    b = F.size(F.filter(inner, lambda e: e <= F.col("p")))
    g = t.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("y").alias("true_freq"),
                                      F.avg("p").alias("pred_mean"))
    e = F.array(*[F.lit(x) for x in edges])
    return g.select(F.col("bin").cast("int").alias("bin"), F.element_at(e, F.col("bin") + 1).alias("lo"),
                    F.element_at(e, F.col("bin") + 2).alias("hi"), F.col("count").cast("long").alias("count"),
                    "true_freq", "pred_mean")


def calibration_classification(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Brier, ECE (count-weighted |freq - mean| over non-empty bins), MCE."""
    bins = reliability_bins(df, y, p, n_bins)
    br = brier_score(df, y, p)
    s = bins.agg((F.sum(F.col("count") * F.abs(F.col("true_freq") - F.col("pred_mean"))) / F.sum("count")).alias("ece"),
                 F.coalesce(F.max(F.abs(F.col("true_freq") - F.col("pred_mean"))), F.lit(0.0)).alias("mce"))
    b = br.first()["brier"]
    return s.select(F.lit(b).cast("double").alias("brier"), "ece", "mce")


def calibration_regression(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Slope, intercept and R² of y regressed on the prediction."""
    t = _yp(df, y, yhat)
    return t.agg(F.regr_slope("y", "p").alias("calibration_slope"),
                 F.regr_intercept("y", "p").alias("calibration_intercept"),
                 F.regr_r2("y", "p").alias("calibration_r2"))


def platt_scaling(train: DataFrame, y: str, p: str, apply_to: DataFrame | None = None,
                  out: str = "p_platt") -> DataFrame:
    """Unpenalised logistic regression of y on p, applied to ``apply_to``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=[p], outputCol="__f", handleInvalid="skip")
    t = va.transform(_yp(train, y, p).withColumnRenamed("p", p).withColumnRenamed("y", "__y"))
    m = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=0.0, standardization=False).fit(t)
    a, b = float(m.intercept), float(m.coefficients[0])
    target = apply_to if apply_to is not None else train
    return target.withColumn(out, 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * q(p).cast("double")))))


def isotonic_recalibration(train: DataFrame, y: str, p: str, apply_to: DataFrame | None = None,
                           out: str = "p_isotonic") -> DataFrame:
    """MLlib isotonic regression of y on p (clipped outside the fitted range)."""
    from pyspark.ml.regression import IsotonicRegression
    t = _yp(train, y, p).select(F.col("y").alias("__y"), F.col("p").alias("__p"))
    m = IsotonicRegression(featuresCol="__p", labelCol="__y").fit(t)
    target = apply_to if apply_to is not None else train
    return m.setFeaturesCol("__p").setPredictionCol(out).transform(
        target.withColumn("__p", q(p).cast("double"))).drop("__p")


def decision_curve(df: DataFrame, y: str, probas: Mapping[str, str] | Sequence[str],
                   thresholds: Sequence[float] | None = None) -> DataFrame:
    """Net benefit tp/n - fp/n · t/(1 - t) per threshold and model, plus
    treat-all and treat-none; one aggregation with 2 x |t| conditional sums
    per model, stacked to long form."""
    if thresholds is None:
        thresholds = [float(x) for x in np.arange(0.01, 1.0, 0.01)]
    probas = dict(probas) if isinstance(probas, Mapping) else {c: c for c in probas}
    yy = q(y).cast("double")
    t = df.where(yy.isNotNull())
    exprs = [F.count(F.lit(1)).alias("n"), F.sum(yy).alias("npos")]
    for m, (name, col) in enumerate(probas.items()):
        p = q(col).cast("double")
        for i, th in enumerate(thresholds):
            exprs += [F.sum(((p >= th) & (yy == 1)).cast("long")).alias(f"tp{m}_{i}"),
                      F.sum(((p >= th) & (yy == 0)).cast("long")).alias(f"fp{m}_{i}")]
    row = t.agg(*exprs)
    structs = []
    for i, th in enumerate(thresholds):
        w = th / (1 - th)
        structs.append(F.struct(F.lit("Treat All").alias("model"), F.lit(th).alias("threshold"),
                                (F.col("npos") / F.col("n") - (1 - F.col("npos") / F.col("n")) * w).alias("net_benefit")))
        structs.append(F.struct(F.lit("Treat None").alias("model"), F.lit(th).alias("threshold"),
                                F.lit(0.0).alias("net_benefit")))
        for m, name in enumerate(probas):
            structs.append(F.struct(F.lit(name).alias("model"), F.lit(th).alias("threshold"),
                                    (F.col(f"tp{m}_{i}") / F.col("n") - F.col(f"fp{m}_{i}") / F.col("n") * w)
                                    .alias("net_benefit")))
    return row.select(F.inline(F.array(*structs)))
