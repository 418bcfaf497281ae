"""Robustness of results (ops 172-174): refits over seeds, feature dropout and
the summary table.  Linear models drop features from the Gram matrices
(no refit over rows); other models refit per variation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import q
from cohortspark.operators.gram import gram, rss

# Coefficient-of-variation bands (%) for seed stability.
CV_BANDS = ((2.0, "very stable"), (5.0, "stable"), (10.0, "moderate"))


def seed_sensitivity(train_fn: Callable[[int], object], eval_fn: Callable[[object], dict],
                     seeds: Sequence[int] = (0, 1, 7, 13, 99, 123, 456), baseline_seed: int = 42,
                     metric: str | None = None) -> DataFrame:
    """Metrics of refits over all given seeds, baseline first (op 172)."""
    spark = SparkSession.getActiveSession()
    rows = [("Baseline", baseline_seed, eval_fn(train_fn(baseline_seed)))]
    for s in seeds:
        if s == baseline_seed:
            continue
        rows.append(("seed", s, eval_fn(train_fn(s))))
    names = sorted(rows[0][2])
    return spark.createDataFrame([(v, int(s), *[float(m[n]) for n in names]) for v, s, m in rows],
                                 "variation string, seed long, " + ", ".join(f"{n} double" for n in names))


def seed_stability(results: DataFrame, metric: str) -> DataFrame:
    """mean, sd, range and CV% of one metric over the seed variations, with
    the stability band."""
    v = results.where(F.col("variation") != "Baseline")
    s = v.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.min(metric).alias("min"),
              F.max(metric).alias("max"))
    cv = F.abs(F.col("sd") / F.col("mean")) * 100
    band = F.when(cv < CV_BANDS[0][0], CV_BANDS[0][1]).when(cv < CV_BANDS[1][0], CV_BANDS[1][1]) \
        .when(cv < CV_BANDS[2][0], CV_BANDS[2][1]).otherwise("unstable")
    return s.select("mean", "sd", (F.col("max") - F.col("min")).alias("range"), cv.alias("cv_pct"), band.alias("band"))


def feature_dropout_linear(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                           alpha: float = 0.0, max_features: int | None = None) -> DataFrame:
    """Held-out RMSE of OLS / ridge without each feature in turn, from one Gram
    of the training rows and one of the test rows (op 173)."""
    feats = list(features)[:max_features]
    cols = feats + [label]
    gtr = next(iter(gram(train.where(q(label).isNotNull()), cols).values()))
    gte = next(iter(gram(test.where(q(label).isNotNull()), cols).values()))

    def fit_rmse(keep):
        sub = gtr.sub(keep + [label])
        ix = list(range(len(keep)))
        b = np.linalg.lstsq(sub.scatter[np.ix_(ix, ix)] + alpha * np.eye(len(ix)), sub.scatter[ix, len(ix)], rcond=None)[0]
        a = float(sub.mean[len(ix)] - sub.mean[ix] @ b)
        return float(np.sqrt(rss(gte.sub(keep + [label]), keep, label, a, b) / gte.n))
    base = fit_rmse(feats)
    rows = [(f, fit_rmse([g for g in feats if g != f])) for f in feats]
    spark = train.sparkSession
    out = spark.createDataFrame([(f, v, v - base, base) for f, v in rows],
                                "dropped string, rmse double, impact double, baseline_rmse double")
    return out.orderBy(F.desc("impact"))


def feature_dropout(fit_fn: Callable[[list[str]], object], eval_fn: Callable[[object], float],
                    features: Sequence[str], max_features: int | None = None) -> DataFrame:
    """Refit without each feature for non-linear models; impact = metric change."""
    feats = list(features)[:max_features]
    base = eval_fn(fit_fn(feats))
    rows = [(f, float(eval_fn(fit_fn([g for g in feats if g != f])))) for f in feats]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, v, v - base, base) for f, v in rows],
                                 "dropped string, metric double, impact double, baseline double").orderBy(F.desc("impact"))


def robustness_summary(results: DataFrame, metric: str, analysis: str = "analysis",
                       variation: str = "variation", tolerance: float = 0.1) -> DataFrame:
    """Per analysis: baseline, mean, sd (pop), range and whether every
    variation is within ``tolerance`` of the baseline (op 174)."""
    base = results.where(F.col(variation) == "Baseline").select(analysis, F.col(metric).alias("baseline"))
    var = results.where(F.col(variation) != "Baseline")
    j = var.join(base, analysis)
    rel = F.when(F.col("baseline") == 0, F.lit(0.0)).otherwise(F.abs(F.col(metric) - F.col("baseline")) / F.abs(F.col("baseline")))
    return j.groupBy(analysis).agg(
        F.first("baseline").alias("baseline"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"),
        F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(F.lit(1)).alias("n_variations"),
        F.max(rel).alias("max_rel_change"), (F.max(rel) <= tolerance).alias("robust"))
