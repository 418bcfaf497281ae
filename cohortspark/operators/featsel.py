"""Feature selection (ops 120-125).

Linear selectors never refit on rows: one scan builds per-fold (or
per-replicate) Gram matrices, and every path, elimination round and
held-out error is p×p algebra on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import by_column
from cohortspark.session import written
from cohortspark.functions.columns import q
from cohortspark.functions.pvalues import t_pvalue
from cohortspark.operators.gram import Gram, gram, rss, total
from cohortspark.operators.htest import p_adjust
from cohortspark.operators.ranks import attach, value_positions
from cohortspark.operators.split import kfold, uniform


# ------------------------------------------------------------- lasso on a Gram

def lasso_cd(g: Gram, x: Sequence[str], y: str, alpha: float, b0: np.ndarray | None = None,
             max_iter: int = 1000, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """Coordinate descent for RSS/(2n) + alpha·|b|₁ with intercept, on the
    centred scatter matrix (covariance-update form)."""
    ix, iy = g.index(x), g.index([y])[0]
    s = g.scatter[np.ix_(ix, ix)]
    c = g.scatter[ix, iy]
    n = g.n
    p = len(ix)
    b = np.zeros(p) if b0 is None else b0.copy()
    thr = n * alpha
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if s[j, j] <= 0:
                continue
            rho = c[j] - s[j] @ b + s[j, j] * b[j]
            nb = np.sign(rho) * max(abs(rho) - thr, 0.0) / s[j, j]
            delta = max(delta, abs(nb - b[j]) * np.sqrt(s[j, j]))
            b[j] = nb
        if delta < tol * np.sqrt(max(g.scatter[iy, iy], 1e-300)):
            break
    a = float(g.mean[iy] - g.mean[ix] @ b)
    return a, b


def lasso_path_cv(df: DataFrame, features: Sequence[str], y: str, n_alphas: int = 100, folds: int = 5,
                  key: Sequence[str] | None = None, seed: int = 42, eps: float = 1e-3) -> dict:
    """Lasso path with k-fold CV from per-fold Grams in one scan (op 120).

    Returns dict with DataFrames ``coefficients`` (feature, coef, selected),
    ``path`` (alpha, feature, coef) and ``cv`` (alpha, mse_mean, mse_sd) and the
    chosen ``alpha``."""
    feats = list(features)
    d = kfold(df.where(q(y).isNotNull()), folds, key, seed, "__fold")
    gs = gram(d, feats + [y], by=["__fold"])
    tot = total(gs)
    ix, iy = tot.index(feats), tot.index([y])[0]
    amax = float(np.max(np.abs(tot.scatter[ix, iy])) / tot.n)
    alphas = np.logspace(np.log10(amax), np.log10(amax * eps), n_alphas) if amax > 0 else np.array([0.0])
    mse = np.zeros((len(alphas), len(gs)))
    for fi, (k, gk) in enumerate(sorted(gs.items())):
        tr = tot - gk
        b = None
        for ai, a in enumerate(alphas):
            a0, b = lasso_cd(tr, feats, y, a, b)
            mse[ai, fi] = rss(gk, feats, y, a0, b) / gk.n
    best = int(np.argmin(mse.mean(1)))
    path_rows, b = [], None
    for a in alphas:
        _a0, b = lasso_cd(tot, feats, y, a, b)
        path_rows += [(float(a), f, float(v)) for f, v in zip(feats, b)]
    a0, bb = lasso_cd(tot, feats, y, alphas[best])
    spark = df.sparkSession
    coef = spark.createDataFrame([(f, float(v), bool(abs(v) > 1e-10)) for f, v in zip(feats, bb)],
                                 "feature string, coef double, selected boolean")
    path = spark.createDataFrame(path_rows, "alpha double, feature string, coef double")
    cv = spark.createDataFrame([(float(a), float(m.mean()), float(m.std())) for a, m in zip(alphas, mse)],
                               "alpha double, mse_mean double, mse_sd double")
    return {"coefficients": coef, "path": path, "cv": cv, "alpha": float(alphas[best]), "intercept": a0}


def l1_logistic_cv(df: DataFrame, features: Sequence[str], y: str, n_cs: int = 10, folds: int = 5,
                   key: Sequence[str] | None = None, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """L1 logistic regression over a grid of C (log-spaced 1e-4..1e4) chosen by
    k-fold CV on accuracy (op 121), with MLlib ``CrossValidator`` on a
    hash fold column; returns the refit coefficients and selection flags."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    feats = list(features)
    d = kfold(df.where(q(y).isNotNull()), folds, key, seed, "__fold")
    va = VectorAssembler(inputCols=feats, outputCol="__f", handleInvalid="skip")
    t = va.transform(d.select(*[q(c).cast("double").alias(c) for c in feats], q(y).cast("double").alias("__y"), "__fold"))
    n = t.count()
    lr = LogisticRegression(featuresCol="__f", labelCol="__y", elasticNetParam=1.0, standardization=False, maxIter=200)
    cs = np.logspace(-4, 4, n_cs)
    grid = ParamGridBuilder().addGrid(lr.regParam, [float(1.0 / (c * n)) for c in cs]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, foldCol="__fold", parallelism=parallelism,
                        evaluator=MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy"))
    m = cv.fit(t).bestModel
    coefs = m.coefficients.toArray() if m.numClasses <= 2 else np.abs(m.coefficientMatrix.toArray()).max(0)
    return df.sparkSession.createDataFrame([(f, float(v), bool(abs(v) > 1e-10)) for f, v in zip(feats, coefs)],
                                           "feature string, coef double, selected boolean")


# ------------------------------------------------------------------- RFE-CV

def _ridge(g: Gram, x, y, alpha):
    ix, iy = g.index(x), g.index([y])[0]
    b = np.linalg.solve(g.scatter[np.ix_(ix, ix)] + alpha * np.eye(len(ix)), g.scatter[ix, iy])
    return float(g.mean[iy] - g.mean[ix] @ b), b


def _elimination(g: Gram, feats, y, alpha):
    cur = list(feats)
    order = []
    while len(cur) > 1:
        _a, b = _ridge(g, cur, y, alpha)
        j = int(np.argmin(np.abs(b)))
        order.append(cur.pop(j))
    order.append(cur[0])
    return order  # first eliminated ... last survivor


def rfe_cv(df: DataFrame, features: Sequence[str], y: str, folds: int = 5, alpha: float = 1.0,
           key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Recursive feature elimination with ridge (alpha = 1), step 1, the number
    of features chosen by k-fold held-out MSE; rankings (1 = kept) and score
    1/rank (op 122).  All fits come from per-fold Grams of one scan."""
    feats = list(features)
    d = kfold(df.where(q(y).isNotNull()), folds, key, seed, "__fold")
    gs = gram(d, feats + [y], by=["__fold"])
    tot = total(gs)
    p = len(feats)
    scores = np.zeros((p, len(gs)))
    for fi, (k, gk) in enumerate(sorted(gs.items())):
        tr = tot - gk
        order = _elimination(tr, feats, y, alpha)
        for m in range(1, p + 1):
            keep = order[p - m:]
            a, b = _ridge(tr, keep, y, alpha)
            scores[m - 1, fi] = rss(gk.sub(keep + [y]), keep, y, a, b) / gk.n
    best_m = int(np.argmin(scores.mean(1))) + 1
    order = _elimination(tot, feats, y, alpha)
    rank = {}
    for i, f in enumerate(order):
        pos_from_end = p - i  # last survivor -> 1
        rank[f] = max(1, pos_from_end - best_m + 1)
    rows = [(f, int(rank[f]), 1.0 / rank[f], rank[f] == 1) for f in feats]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking long, score double, selected boolean")


# -------------------------------------------------------- univariate screen (123)

def univariate_screen(df: DataFrame, features: Sequence[str], y: str, task: str = "regression",
                      alpha: float = 0.05) -> DataFrame:
    """|Pearson r| (regression) or |Spearman ρ| (classification) for every
    feature with t-based p-values and Benjamini-Hochberg / Bonferroni
    adjustment.  Spearman ranks for all features come from one long-form pass
    of the rank primitive (ranks within each feature's complete pairs)."""
    feats = list(features)
    yy = q(y).cast("double")
    if task == "regression":
        row = df.agg(*[F.corr(q(f).cast("double"), yy).alias(f"r{i}") for i, f in enumerate(feats)],
                     *[F.count(F.when(q(f).isNotNull() & yy.isNotNull(), 1)).alias(f"n{i}") for i, f in enumerate(feats)])
        st = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r"),
                                                    F.col(f"n{i}").alias("n")) for i, f in enumerate(feats)])))
    else:
        long = (df.select(yy.alias("y"), *[q(f).cast("double").alias(f) for f in feats])
                .unpivot("y", feats, "feature", "x").dropna())
        cells = written(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("c")), "rank-cells")
        sizes = {r["feature"]: r["n"] for r in cells.groupBy("feature").agg(F.sum("c").alias("n")).collect()}
        ranked = cells
        for v in ("x", "y"):
            pos = value_positions(cells, v, by=["feature"], weight="c").withColumnRenamed("avg_rank", f"r{v}")
            ranked = attach(ranked, pos, ["feature", v], [f"r{v}"])
        middle = (by_column(sizes, "double", key="feature") + 1) / 2
        u, v, c = F.col("rx") - middle, F.col("ry") - middle, F.col("c")
        st = ranked.groupBy("feature").agg(
            (F.sum(c * u * v) / F.sqrt(F.sum(c * u * u) * F.sum(c * v * v))).alias("r"), F.sum("c").alias("n"))
    n = F.col("n").cast("double")
    t = F.col("r") * F.sqrt((n - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    st = st.select("feature", "r", F.abs("r").alias("abs_r"), F.col("n").cast("long").alias("n"),
                   F.when(F.abs(F.col("r")) >= 1, 0.0).otherwise(t_pvalue(t, n - 2)).alias("p_value"))
    adj = p_adjust(st, "p_value", "feature")
    return adj.withColumn("selected", F.col("p_fdr_bh") < alpha)


# --------------------------------------------------------- stability selection (124)

def gram_replicates(df: DataFrame, cols: Sequence[str], n_rep: int, seed: int, fraction: float = 0.5,
                    key: Sequence[str] | None = None) -> list[Gram]:
    """Grams of ``n_rep`` hash half-samples from one scan: each Arrow batch
    forms the rows x R 0/1 membership matrix and contracts it with the rows'
    outer products (einsum), one record per task."""
    cols = list(cols)
    keys = [q(k) for k in (key or df.columns)]
    sel = df.select(*[q(c).cast("double").alias(c) for c in cols], *[
        (uniform(seed + 7919, F.lit(r), *keys) < F.lit(fraction)).cast("double").alias(f"__w{r}")
        for r in range(n_rep)]).dropna(subset=cols)
    center = np.array([v if v is not None else 0.0 for v in sel.agg(*[F.avg(c) for c in cols]).first()])
    p = len(cols)
    wcols = [f"__w{r}" for r in range(n_rep)]

    def fn(batches):
        sw = np.zeros(n_rep)
        s1 = np.zeros((n_rep, p))
        s2 = np.zeros((n_rep, p, p))
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64") - center
            w = pdf[wcols].to_numpy(dtype="float64")
            sw += w.sum(0)
            s1 += w.T @ x
            s2 += np.einsum("nr,ni,nj->rij", w, x, x, optimize=True)
        yield pd.DataFrame({"sw": [sw.tobytes()], "s1": [s1.tobytes()], "s2": [s2.tobytes()]})

    parts = sel.mapInPandas(fn, "sw binary, s1 binary, s2 binary")
    red = parts.rdd.map(lambda r: (np.frombuffer(r["sw"]), np.frombuffer(r["s1"]).reshape(n_rep, p),
                                   np.frombuffer(r["s2"]).reshape(n_rep, p, p))) \
        .treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    sw, s1, s2 = red
    out = []
    for r in range(n_rep):
        d = s1[r] / sw[r]
        out.append(Gram(cols, float(sw[r]), center + d, s2[r] - sw[r] * np.outer(d, d)))
    return out


def stability_selection(df: DataFrame, features: Sequence[str], y: str, n_bootstrap: int = 100,
                        threshold: float = 0.6, alpha: float = 0.01, sample_fraction: float = 0.5,
                        key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Selection frequency of lasso (alpha = .01) over hash half-samples (op 124);
    all replicate Grams come from one scan."""
    feats = list(features)
    gs = gram_replicates(df.where(q(y).isNotNull()), feats + [y], n_bootstrap, seed, sample_fraction, key)
    counts = np.zeros(len(feats))
    for g in gs:
        _a, b = lasso_cd(g, feats, y, alpha)
        counts += np.abs(b) > 1e-10
    freq = counts / len(gs)
    return df.sparkSession.createDataFrame([(f, float(v), bool(v >= threshold)) for f, v in zip(feats, freq)],
                                           "feature string, frequency double, selected boolean")


# ------------------------------------------------------------------ consensus (125)

def consensus(selections: DataFrame, min_methods: int = 2, method: str = "method",
              feature: str = "feature") -> DataFrame:
    """Features selected by at least ``min_methods`` methods, most-selected first."""
    c = selections.groupBy(F.col(feature).alias("feature")).agg(
        F.count_distinct(F.col(method)).alias("n_methods"),
        F.sort_array(F.collect_set(F.col(method))).alias("methods"))
    return c.where(F.col("n_methods") >= min_methods)
