"""Model explanation (ops 168-171).

Every explanation is a bounded expansion of the data -- (feature, repeat)
copies, (row, grid value) pairs or (row, permutation, step) states -- scored by
the model in one Spark job and averaged; rows are never collected.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.aggs import scalar_quantiles
from cohortspark.functions.columns import explode_copies, q
from cohortspark.operators.models import FittedModel
from cohortspark.operators.ranks import value_positions


def _score_col(task: str, label: str) -> tuple:
    if task == "regression":
        e = F.col(label).cast("double") - F.col("prediction")
        return lambda: (1 - F.sum(e * e) / (F.sum(F.col(label).cast("double") ** 2)
                                            - F.sum(F.col(label).cast("double")) ** 2 / F.count(F.lit(1)))), "r2"
    return lambda: F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double")), "accuracy"


def permutation_importance(model: FittedModel, df: DataFrame, label: str, task: str,
                           key: Sequence[str] | None = None, n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Score drop when one feature is permuted, mean and sd over repeats (op 168).

    Rows are put in a random order by a keyed hash (positions from the rank
    primitive); repeat r gives every row the feature value of the row s_r
    places further along that order (cyclic), so each repeat is a random
    derangement of the column.  All (feature, repeat) copies are scored in one
    job: the data grow by p x repeats, never quadratically.

    Keys may repeat: equal rows are counted and numbered, the number is part
    of the hash, and rows whose hashes still agree follow each other, so every
    row has a position of its own and takes part in every repeat.
    """
    feats = list(model.features)
    cols = list(dict.fromkeys(feats + [label]))
    known = df.where(q(label).isNotNull()).select(
        *[q(c) for c in cols], F.xxhash64(F.lit(seed), *[q(k) for k in (key or df.columns)]).alias("__k"))
    rows = explode_copies(known.groupBy(*[q(c) for c in cols], "__k").agg(F.count(F.lit(1)).alias("__n")), "__n", "__copy")
    h = F.xxhash64("__k", "__copy", *[q(c) for c in cols])
    base = rows.select(*[q(c) for c in cols], h.alias("__h"), "__copy")
    pos = value_positions(base, "__h").select("__h", "before")
    tie = F.row_number().over(Window.partitionBy("__h").orderBy("__copy", *[q(c) for c in cols])) - 1
    b = base.join(pos, "__h").select(*[q(c) for c in cols], (F.col("before") + tie).alias("__pos"))
    n = b.count()
    rng = random.Random(seed)
    shifts = [1 + rng.randrange(max(n - 1, 1)) for _ in range(n_repeats)]
    partner = b.select("__pos", *[q(f).alias(f"__p_{f}") for f in feats])
    reps = b.select("*", F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.lit(s).alias("shift"))
                                             for r, s in enumerate(shifts)])).alias("__r"))
    reps = reps.select("*", "__r.rep", ((F.col("__pos") + F.col("__r.shift")) % F.lit(n)).alias("__tpos")).drop("__r")
    joined = reps.join(partner.withColumnRenamed("__pos", "__tpos"), "__tpos")
    copies = joined.select(q(label), "rep", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[(F.col(f"__p_{g}") if g == f else q(g)).alias(g) for g in feats])
        for f in feats])).alias("__c")).select(q(label), "rep", "__c.*")
    score, name = _score_col(task, label)
    base_score = model.transform(b).agg(score().alias("s")).first()["s"]
    perm = model.transform(copies).groupBy("feature", "rep").agg(score().alias("s"))
    drop = F.lit(base_score) - F.col("s")
    return (perm.groupBy("feature").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_sd"),
                                        F.count(F.lit(1)).alias("n_repeats"))
            .withColumn("baseline_" + name, F.lit(base_score)))


def partial_dependence(model: FittedModel, df: DataFrame, features: Sequence[str], grid_points: int = 20) -> DataFrame:
    """Average prediction with one feature set to each grid value (op 169):
    grid = distinct values if at most ``grid_points``, else equally spaced
    between the 5th and 95th percentiles; all rows x grid scored in one job."""
    out = None
    cols = list(dict.fromkeys(model.features))
    for f in features:
        x = q(f).cast("double")
        nd = df.agg(F.count_distinct(x)).first()[0]
        if nd <= grid_points:
            grid = sorted(r[0] for r in df.select(x.alias("v")).where("v IS NOT NULL").distinct().collect())
        else:
            lo, hi = scalar_quantiles(df, [f], [0.05, 0.95])[f]
            grid = [float(v) for v in np.linspace(lo, hi, grid_points)]
        g = df.select(*[q(c) for c in cols if c != f], F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias(f))
        pd_ = model.transform(g).groupBy(F.col(f).alias("grid_value")).agg(F.avg("prediction").alias("avg_prediction"))
        pd_ = pd_.select(F.lit(f).alias("feature"), "grid_value", "avg_prediction")
        out = pd_ if out is None else out.unionByName(pd_)
    return out


def linear_shap(df: DataFrame, intercept: float, coef: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """φ_j = b_j (x_j - mean_j) for a linear model; mean |φ_j| per feature,
    ranked (op 170).  Means come from the background (training) data."""
    bg = background if background is not None else df
    feats = list(coef)
    means = bg.agg(*[F.avg(q(f).cast("double")).alias(f) for f in feats]).first()
    row = df.agg(*[F.avg(F.abs(F.lit(coef[f]) * (q(f).cast("double") - F.lit(means[f])))).alias(f"s{i}")
                   for i, f in enumerate(feats)])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("mean_abs_shap"))
                                         for i, f in enumerate(feats)])))
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))


def sampled_shapley(model: FittedModel, df: DataFrame, key: Sequence[str], n_permutations: int = 10,
                    background: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley values for any model (op 171).

    For each row and each of M random feature orders, features are switched
    from the background mean to the row's value one at a time; the change in
    prediction at each step is that feature's contribution.  Rows x M x (p+1)
    states are scored in one job; a state's prediction counts for the feature
    just added and against the one added next, so a row's values are signed
    sums, combined within the task that scores the row.  Rows that share a key
    but differ are kept apart, equal rows are counted and given back.
    Returns per-row values (long form): row_id (hash of the key), feature, shap."""
    feats = list(model.features)
    p = len(feats)
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(q(f).cast("double")).alias(f) for f in feats]).first()
    rng = random.Random(seed)
    perms = [rng.sample(range(p), p) for _ in range(n_permutations)]
    states = []
    for m, perm in enumerate(perms):
        for step in range(p + 1):
            on = set(perm[:step])
            signs = [F.struct(F.lit(feats[perm[at]]).alias("feature"), F.lit(sign).alias("sign"))
                     for at, sign in ((step - 1, 1.0), (step, -1.0)) if 0 <= at < p]
            states.append(F.struct(F.array(*signs).alias("__signs"),
                                   *[(q(f).cast("double") if i in on else F.lit(float(means[f]))).alias(f)
                                     for i, f in enumerate(feats)]))
    rid = F.xxhash64(*[q(k) for k in key]).alias("row_id")
    own = F.xxhash64(F.lit(1), *[q(c) for c in dict.fromkeys([*key, *feats])]).alias("__own")
    ex = df.select(rid, own, F.explode(F.array(*states)).alias("__s")).select("row_id", "__own", "__s.*")
    signed = model.transform(ex).select("row_id", "__own", "prediction", F.inline("__signs"))
    up = (F.col("sign") > 0).cast("long")
    sums = signed.groupBy("row_id", "__own", "feature").agg(
        F.sum(F.col("sign") * F.col("prediction")).alias("s"), F.sum(up).alias("u"))
    sums = sums.select("row_id", "feature", (F.col("s") / F.col("u")).alias("shap"),
                       (F.col("u") / n_permutations).cast("long").alias("__n"))
    return explode_copies(sums, "__n", "__copy").select("row_id", "feature", "shap")


def shap_importance(values: DataFrame) -> DataFrame:
    """Mean |φ| per feature from per-row Shapley values."""
    return (values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature"))))
