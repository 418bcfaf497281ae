"""Association, collinearity and regression diagnostics (ops 94-104)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import dist
from cohortspark.functions.aggs import scalar_quantiles
from cohortspark.functions.columns import numeric_cols, q
from cohortspark.functions.topk import top_k_per_group
from cohortspark.operators import htest
from cohortspark.operators.gram import gram, total

# ------------------------------------------------------------ correlation (94-96)


def top_variance_columns(df: DataFrame, cols: Sequence[str], k: int) -> list[str]:
    row = df.agg(*[F.var_samp(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    ranked = sorted(((row[f"v{i}"] if row[f"v{i}"] is not None else -1.0, -i, c) for i, c in enumerate(cols)),
                    reverse=True)
    return [c for _v, _i, c in ranked[:k]]


def _corr(x, y):
    """Pairwise-complete Pearson correlation, NULL where a side is constant (``corr`` fails there in ANSI mode)."""
    spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Long pairwise-complete correlation table (col_a, col_b, r, abs_r), a before b.

    One aggregation for all pairs, pairwise-complete; all columns, or if ``max_cols`` is
    given that many of the highest variance.
    """
    cols = list(cols) if cols is not None else numeric_cols(df)
    if max_cols is not None and len(cols) > max_cols:
        keep = set(top_variance_columns(df, cols, max_cols))
        cols = [c for c in cols if c in keep]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double, abs_r double")
    row = df.agg(*[_corr(q(a).cast("double"), q(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{i}").alias("r"))
               for i, (a, b) in enumerate(pairs)]
    long = row.select(F.inline(F.array(*structs)))
    return long.select("col_a", "col_b", "r", F.abs("r").alias("abs_r"))


def collinear_pairs(corr_long: DataFrame, threshold: float = 0.85) -> DataFrame:
    return corr_long.where(F.col("abs_r") > threshold)


def leakage_scan(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                 threshold: float = 0.95) -> DataFrame:
    """|corr(feature, target)| per feature, flagged above the threshold."""
    cols = [c for c in (cols if cols is not None else numeric_cols(df)) if c != target]
    y = q(target).cast("double")
    row = df.agg(*[_corr(q(c).cast("double"), y).alias(f"c{i}") for i, c in enumerate(cols)])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("r"))
                                         for i, c in enumerate(cols)])))
    return long.select("column", "r", F.abs("r").alias("abs_r"), (F.abs("r") > threshold).alias("leak_suspect"))


# ------------------------------------------------------ top-k association (97)

def top_associations(df: DataFrame, target: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top k features by |Pearson r| with a numeric target."""
    ls = leakage_scan(df, target, cols, threshold=2.0).where(F.col("r").isNotNull())
    return top_k_per_group(ls.withColumn("_g", F.lit(1)), ["_g"], [F.desc("abs_r"), F.asc("column")], k,
                           salt_on=["column"], rank_col="rank").drop("_g", "leak_suspect")


def _below(x: Column):
    """filter predicate e < x (a one-argument lambda: PySpark reads two as (e, i))."""
    return lambda e: e < x


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between quantile-binned features and a
    class target over all rows.  Edges from one quantile agg; counts from one
    groupBy over the unpivoted (feature, bin, class) triples."""
    cols = list(cols)
    probs = [i / bins for i in range(1, bins)]
    quant = scalar_quantiles(df, cols, probs)
    binned = []
    for i, c in enumerate(cols):
        edges = sorted({e for e in quant[c] if e is not None})
        arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
        x = q(c).cast("double")
        binned.append(F.when(x.isNotNull(), F.size(F.filter(arr, _below(x)))).alias(c))
    t = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("y"), *binned)
    long = t.unpivot("y", cols, "feature", "bin").where(F.col("bin").isNotNull())
    cells = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    wf, wb, wy = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "y")
    c2 = cells.select("feature", "n", F.sum("n").over(wf).alias("tot"), F.sum("n").over(wb).alias("nb"),
                      F.sum("n").over(wy).alias("ny"))
    mi = c2.groupBy("feature").agg(
        F.sum(F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("nb") * F.col("ny")))).alias("mi"))
    return mi


# ------------------------------------------------------------ dose-response (98)

def dose_response(df: DataFrame, feature: str, target: str, max_bins: int = 10) -> DataFrame:
    """Quantile bins (min(10, n // 10), at least 3, duplicate edges dropped),
    right-closed with the minimum in the first bin: bin, lo, hi, mid, n, mean target."""
    x = q(feature).cast("double")
    n = df.where(x.isNotNull()).count()
    nb = min(max_bins, n // 10)
    if nb < 3:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, mid double, n long, mean_target double")
    edges = sorted(set(scalar_quantiles(df, [feature], [i / nb for i in range(nb + 1)])[feature]))
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    b = F.size(F.filter(inner, lambda e: e < x)).cast("int")
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                          F.avg(q(target).cast("double")).alias("mean_target"))
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 2)
    return g.select("bin", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("mid"),
                    F.col("n").cast("long").alias("n"), "mean_target")


# ------------------------------------------------------------ linearity (99)

def linearity_tests(df: DataFrame, target: str, features: Sequence[str], k: int = 6) -> DataFrame:
    """Spearman if the target is not normal, else Pearson, for the top-k features."""
    top = [r["column"] for r in top_associations(df, target, features, k).collect()]
    method = "pearson" if htest.is_normal(df, target) else "spearman"
    out = None
    for c in top:
        t = htest.correlation_test(df, c, target, method).withColumn("feature", F.lit(c))
        out = t if out is None else out.unionByName(t)
    return out


# ------------------------------------------------------- OLS proxy (100-103)

def _impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    fills = {c: v[0] for c, v in scalar_quantiles(df, cols, [0.5]).items()}
    return df.select("*", *[F.coalesce(q(c).cast("double"), F.lit(fills[c])).alias(f"__x{i}")
                            for i, c in enumerate(cols)])


def ols_fit(df: DataFrame, target: str, features: Sequence[str]) -> dict:
    """Median-impute features, drop missing target, OLS with intercept from one Gram."""
    feats = list(features)
    d = _impute_median(df, feats).where(q(target).isNotNull())
    xs = [f"__x{i}" for i in range(len(feats))]
    d = d.select(*xs, q(target).cast("double").alias("__y"))
    g = total(gram(d, xs + ["__y"]))
    ix = list(range(len(xs)))
    sxx = g.scatter[np.ix_(ix, ix)]
    b = np.linalg.lstsq(sxx, g.scatter[ix, len(xs)], rcond=None)[0]
    a = float(g.mean[len(xs)] - g.mean[ix] @ b)
    return {"data": d, "x": xs, "intercept": a, "coef": b, "gram": g, "features": feats}


def _pred(fit: dict) -> Column:
    e = F.lit(fit["intercept"])
    for c, b in zip(fit["x"], fit["coef"]):
        e = e + F.col(c) * F.lit(float(b))
    return e


def ols_residuals(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """y, fitted and residual columns of the OLS proxy (op 100)."""
    fit = ols_fit(df, target, features)
    yhat = _pred(fit)
    return fit["data"].select(F.col("__y").alias("y"), yhat.alias("fitted"), (F.col("__y") - yhat).alias("residual"))


def influence(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Leverage h and Cook's D per row without an n×n hat matrix (op 101).

    h = 1/n + (x-m)' S⁻¹ (x-m) with S the centred scatter (Cholesky, p linear
    combinations per row); D = e²/(k·mse) · h/(1-h)², mse = mean(e²), k = p+1.
    """
    fit = ols_fit(df, target, features)
    g, xs = fit["gram"], fit["x"]
    ix = list(range(len(xs)))
    s = g.scatter[np.ix_(ix, ix)]
    linv = np.linalg.inv(np.linalg.cholesky(s))
    z = []
    for r in range(len(xs)):
        e = F.lit(0.0)
        for j in range(r + 1):
            e = e + F.lit(float(linv[r, j])) * (F.col(xs[j]) - F.lit(float(g.mean[j])))
        z.append(e)
    h = F.lit(1.0 / g.n) + sum([zz * zz for zz in z], F.lit(0.0))
    yhat = _pred(fit)
    res = fit["data"].select(h.alias("h"), (F.col("__y") - yhat).alias("e"))
    mse = res.agg(F.avg(F.col("e") * F.col("e"))).first()[0] + 1e-12
    k = len(xs) + 1
    return res.select("h", "e", (F.col("e") ** 2 / (k * mse) * F.col("h") / (1 - F.col("h")) ** 2).alias("cooks_d"))


def influence_summary(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """max leverage / Cook's D and counts of h > 2k/n and D > 1."""
    return _influence_agg(influence(df, target, features), len(features) + 1)


def _influence_agg(inf: DataFrame, k: int) -> DataFrame:
    n = inf.count()
    return inf.agg(F.lit(n).cast("long").alias("n"), F.max("h").alias("max_leverage"),
                   F.max("cooks_d").alias("max_cooks"),
                   F.sum((F.col("h") > 2.0 * k / n).cast("long")).alias("n_high_leverage"),
                   F.sum((F.col("cooks_d") > 1).cast("long")).alias("n_high_cooks"))


def residual_qq(df: DataFrame, target: str, features: Sequence[str], points: int = 99) -> DataFrame:
    """Residual quantiles against standard-normal quantiles on a fixed grid (op 102)."""
    r = ols_residuals(df, target, features)
    probs = [(i + 0.5) / (points + 1) for i in range(points + 1)]
    qs = scalar_quantiles(r, ["residual"], probs)["residual"]
    rows = [(float(p), float(dist.norm_ppf(p)), float(v)) for p, v in zip(probs, qs)]
    return df.sparkSession.createDataFrame(rows, "prob double, theoretical double, sample double")


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """1 / (1 - R²_j) from the correlation matrix of median-imputed features;
    perfect collinearity -> 999; flag above 10 (op 103)."""
    feats = list(features)
    d = _impute_median(df, feats)
    xs = [f"__x{i}" for i in range(len(feats))]
    g = total(gram(d.select(*xs), xs))
    r = g.corr
    out = []
    for j, c in enumerate(feats):
        others = [i for i in range(len(feats)) if i != j]
        rj = r[others, j]
        sub = r[np.ix_(others, others)]
        r2 = float(rj @ np.linalg.pinv(sub) @ rj) if others else 0.0
        v = 1.0 / (1.0 - r2) if r2 < 1 - 1e-12 else float("inf")
        out.append((c, float(v) if np.isfinite(v) else 999.0))
    sdf = df.sparkSession.createDataFrame(out, "feature string, vif double")
    return sdf.withColumn("high", F.col("vif") > 10)
