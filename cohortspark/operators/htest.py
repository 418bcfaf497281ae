"""Statistical tests (ops 71-91).

Each test computes its statistic with Spark aggregations (moments by group,
distributed ranks, contingency counts) and attaches a p-value column with a
vectorised CDF over the one-row (or one-row-per-feature) statistic table.
Row-scale data never leaves the executors; the Shapiro-Wilk sample is capped
at 5,000 values by definition of the test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import dist
from cohortspark.functions.columns import explode_copies, q
from cohortspark.functions.pvalues import (chi2_pvalue, f_pvalue, fisher_pvalue, mwu_exact_pvalue,
                                           norm_pvalue, t_pvalue, wilcoxon_exact_pvalue)
from cohortspark.operators.ranks import attach, average_ranks, kendall_counts, value_positions

# ----------------------------------------------------------------- correlation


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).dropna()


def _corr_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(n >= 3, F.when(F.abs(r) >= 1, 0.0).otherwise(t_pvalue(t, n - 2)))


def pearson_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    p = _complete(df, x, y)
    return p.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def spearman_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks over the distinct (x, y) cells, weighted by their counts."""
    ranked = average_ranks(_complete(df, x, y), ["x", "y"])
    # the mean rank is (n + 1) / 2, so the sums are centred exactly
    n = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    u, v = F.col("r_x") - (n + 1) / 2.0, F.col("r_y") - (n + 1) / 2.0
    st = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("c") * u * v).alias("uv"),
                    F.sum(F.col("c") * u * u).alias("uu"), F.sum(F.col("c") * v * v).alias("vv"))
    return st.select("n", F.when((F.col("uu") > 0) & (F.col("vv") > 0), F.col("uv") / F.sqrt(F.col("uu") * F.col("vv"))).alias("r"))


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """r, r², p and n on pairwise-complete rows; NaN below n = 3."""
    method = method.lower()
    if method == "kendall":
        return kendall_test(df, x, y)
    st = pearson_stats(df, x, y) if method == "pearson" else spearman_stats(df, x, y)
    n, r = F.col("n"), F.when(F.col("n") >= 3, F.col("r"))
    return st.select(F.lit(method).alias("method"), n.cast("long").alias("n"), r.alias("r"),
                     (r * r).alias("r_squared"), _corr_p(r, n.cast("double")).alias("p_value"),
                     effect_strength(r).alias("strength"))


def kendall_tau(df: DataFrame, x: str, y: str) -> dict:
    """tau-b and p (exact without ties for small n, else tie-corrected normal)."""
    k = kendall_counts(df, x, y)
    n = k["n"]
    if n < 3:
        return {"n": n, "tau": float("nan"), "p_value": float("nan"), "discordant": k["discordant"]}
    tot = n * (n - 1) / 2.0
    con_minus_dis = tot - k["xtie"] - k["ytie"] + k["ntie"] - 2 * k["discordant"]
    denom = math.sqrt((tot - k["xtie"]) * (tot - k["ytie"]))
    if denom == 0:
        return {"n": n, "tau": float("nan"), "p_value": float("nan"), "discordant": k["discordant"]}
    tau = max(-1.0, min(1.0, con_minus_dis / denom))
    dis = k["discordant"]
    if k["xtie"] == 0 and k["ytie"] == 0 and (n <= 33 or min(dis, tot - dis) <= 1):
        p = dist.kendall_exact_p(n, int(min(dis, tot - dis)))
    else:
        m = n * (n - 1.0)
        var = ((m * (2 * n + 5) - k["x1"] - k["y1"]) / 18.0 + (2 * k["xtie"] * k["ytie"]) / m
               + k["x0"] * k["y0"] / (9 * m * (n - 2)))
        z = con_minus_dis / math.sqrt(var)
        p = min(1.0, 2 * dist.norm_sf(abs(z)))
    return {"n": n, "tau": tau, "p_value": p, "discordant": dis}


def kendall_test(df: DataFrame, x: str, y: str) -> DataFrame:
    k = kendall_tau(df, x, y)
    spark = df.sparkSession
    out = spark.createDataFrame([("kendall", int(k["n"]), float(k["tau"]), float(k["tau"]) ** 2,
                                  float(k["p_value"]))],
                                "method string, n long, r double, r_squared double, p_value double")
    return out.withColumn("strength", effect_strength(F.col("r")))


# Fixed values: |r| strength bands.
def effect_strength(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate")
            .when(a < 0.7, "strong").when(a.isNotNull(), "very strong"))


# ------------------------------------------------------------------ two groups

def _two(df: DataFrame, value: str, group: str, g1, g2) -> DataFrame:
    g = q(group)
    return (df.where(g.isin(g1, g2) & q(value).isNotNull())
            .select(q(value).cast("double").alias("v"), (g == F.lit(g1)).alias("first")))


def ttest_ind_stats(df: DataFrame, value: str, group: str, g1, g2) -> DataFrame:
    t = _two(df, value, group, g1, g2)
    v1 = F.when(F.col("first"), F.col("v"))
    v2 = F.when(~F.col("first"), F.col("v"))
    st = t.agg(F.count(v1).alias("n1"), F.count(v2).alias("n2"), F.avg(v1).alias("m1"),
               F.avg(v2).alias("m2"), F.var_samp(v1).alias("s1"), F.var_samp(v2).alias("s2"))
    n1, n2 = F.col("n1"), F.col("n2")
    sp = ((n1 - 1) * F.col("s1") + (n2 - 1) * F.col("s2")) / (n1 + n2 - 2)
    tstat = (F.col("m1") - F.col("m2")) / F.sqrt(sp * (1.0 / n1 + 1.0 / n2))
    ok = (n1 >= 2) & (n2 >= 2)
    return st.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "m1", "m2",
                     F.when(ok, tstat).alias("statistic"), (n1 + n2 - 2).alias("df"))


def mannwhitney_stats(df: DataFrame, value: str, group: str, g1, g2) -> DataFrame:
    """U of the first group, tie term and sizes from pooled distributed ranks."""
    t = _two(df, value, group, g1, g2)
    vc = t.groupBy("v").agg(F.sum(F.col("first").cast("long")).alias("c1"),
                            F.sum((~F.col("first")).cast("long")).alias("c2"))
    pos = value_positions(vc.withColumn("cnt", F.col("c1") + F.col("c2")), "v", weight="cnt")
    j = vc.join(pos.select("v", "avg_rank", "cnt"), "v")
    st = j.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
               F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"),
               F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    return st.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                     u1.alias("statistic"), "ties")


def _mwu_p(st: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2.0 - 0.5) / sigma
    asym = F.least(F.lit(1.0), 2.0 * (1.0 - _phi(z)))
    exact = (((F.col("n1") <= 8) | (F.col("n2") <= 8)) & (F.col("ties") == 0)
             & (F.col("n1") * F.col("n2") <= 20000))
    p = F.coalesce(mwu_exact_pvalue(F.col("statistic"), F.col("n1"), F.when(exact, F.col("n2"))), asym)
    return st.withColumn("p_value", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), p))


def _phi(z: Column) -> Column:
    """Standard normal CDF: 1 - p/2 for z >= 0, p/2 below (p two-sided)."""
    half = norm_pvalue(z) / 2.0
    return F.when(z >= 0, 1.0 - half).otherwise(half)


def two_sample_test(df: DataFrame, value: str, group: str, g1, g2, parametric: bool) -> DataFrame:
    """Pooled-variance t (parametric) or Mann-Whitney U, two-sided."""
    if parametric:
        st = ttest_ind_stats(df, value, group, g1, g2)
        return st.select(F.lit("t-test (ind.)").alias("test"), "n1", "n2", "statistic",
                         t_pvalue(F.col("statistic"), F.col("df")).alias("p_value"))
    st = _mwu_p(mannwhitney_stats(df, value, group, g1, g2))
    return st.select(F.lit("Mann-Whitney U").alias("test"), "n1", "n2", "statistic", "p_value")


# -------------------------------------------------------------------- k groups

def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    x = q(value).cast("double")
    return (df.where(x.isNotNull() & q(group).isNotNull()).groupBy(q(group).alias("group"))
            .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")))


def anova_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """F from group moments; the group table is k rows."""
    gm = group_moments(df, value, group)
    w = Window.partitionBy()  # over k group rows only
    tot = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / tot
    g2 = gm.select("*", grand.alias("gm"), tot.alias("tot_n"), F.count(F.lit(1)).over(w).alias("k"))
    st = g2.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gm"), 2)).alias("ssb"),
                F.sum(F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0))).alias("ssw"),
                F.first("tot_n").alias("tot_n"), F.first("k").alias("k"))
    k, n = F.col("k"), F.col("tot_n")
    fstat = (F.col("ssb") / (k - 1)) / (F.col("ssw") / (n - k))
    return st.select(k.cast("long").alias("k"), n.cast("long").alias("n"),
                     F.when(k >= 2, fstat).alias("statistic"), (k - 1).alias("df1"), (n - k).alias("df2"))


def kruskal_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    x = q(value).cast("double")
    base = df.where(x.isNotNull() & q(group).isNotNull()).select(x.alias("v"), q(group).alias("g"))
    vcg = base.groupBy("v", "g").agg(F.count(F.lit(1)).alias("c"))
    pos = value_positions(vcg, "v", weight="c")
    j = vcg.join(pos.select("v", "avg_rank"), "v")
    rg = j.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("r"))
    ties = pos.agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties")).first()["ties"]
    st = rg.agg(F.sum(F.pow(F.col("r"), 2) / F.col("n")).alias("s"), F.sum("n").alias("N"),
                F.count(F.lit(1)).alias("k"))
    n = F.col("N").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.lit(float(ties or 0)) / (n * n * n - n))
    return st.select(F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("n"),
                     F.when(F.col("k") >= 2, h).alias("statistic"), (F.col("k") - 1).alias("df1"))


def k_sample_test(df: DataFrame, value: str, group: str, parametric: bool) -> DataFrame:
    """One-way ANOVA (parametric) or Kruskal-Wallis with tie correction."""
    if parametric:
        st = anova_stats(df, value, group)
        return st.select(F.lit("ANOVA").alias("test"), "k", "n", "statistic",
                         f_pvalue(F.col("statistic"), F.col("df1"), F.col("df2")).alias("p_value"))
    st = kruskal_stats(df, value, group)
    return st.select(F.lit("Kruskal-Wallis").alias("test"), "k", "n", "statistic",
                     chi2_pvalue(F.col("statistic"), F.col("df1")).alias("p_value"))


# ----------------------------------------------------------------- categorical

def contingency_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form crosstab: (a, b, count) over rows where both are present."""
    return (df.where(q(a).isNotNull() & q(b).isNotNull())
            .groupBy(q(a).alias("a"), q(b).alias("b")).agg(F.count(F.lit(1)).alias("count")))


def chi_square_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square from present cells: Σ o²/e - N; Yates on 2x2."""
    cells = contingency_table(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("count").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("count").alias("cb"))
    dims = cells.agg(F.sum("count").alias("N"), F.count_distinct("a").alias("R"),
                     F.count_distinct("b").alias("C")).first()
    N, R, C = dims["N"] or 0, dims["R"] or 0, dims["C"] or 0
    dof = (R - 1) * (C - 1)
    j = cells.join(rows, "a").join(cols, "b")
    e = F.col("ra") * F.col("cb") / F.lit(float(N) if N else 1.0)
    if R == 2 and C == 2:
        # all four cells (absent ones have o = 0); Yates: move o toward e by min(.5, |e - o|)
        t = two_by_two(df, a, b)
        cells4 = [("n11", "n11 + n12", "n11 + n21"), ("n12", "n11 + n12", "n12 + n22"),
                  ("n21", "n21 + n22", "n11 + n21"), ("n22", "n21 + n22", "n12 + n22")]
        terms = []
        for o, r_, c_ in cells4:
            e4 = F.expr(f"CAST(({r_}) AS DOUBLE) * ({c_}) / CAST({N} AS DOUBLE)")
            diff = e4 - F.col(o)
            o2 = F.col(o) + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
            terms.append(F.pow(o2 - e4, 2) / e4)
        stat = t.select((terms[0] + terms[1] + terms[2] + terms[3]).alias("statistic"))
    else:
        stat = j.agg((F.sum(F.pow(F.col("count"), 2) / e) - F.lit(float(N))).alias("statistic"))
    return stat.select(F.lit(N).cast("long").alias("n"), F.lit(R).cast("long").alias("rows"),
                       F.lit(C).cast("long").alias("cols"), F.lit(dof).cast("long").alias("dof"),
                       F.when(F.lit(dof) > 0, F.col("statistic")).alias("statistic"))


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    st = chi_square_stats(df, a, b)
    return st.select(F.lit("chi-squared").alias("test"), "n", "rows", "cols", "dof", "statistic",
                     chi2_pvalue(F.col("statistic"), F.col("dof")).alias("p_value"))


def two_by_two(df: DataFrame, a: str, b: str) -> DataFrame:
    """The four counts of a 2x2 table (levels in sorted order), absent cells 0."""
    cells = contingency_table(df, a, b)
    la = sorted(r["a"] for r in cells.select("a").distinct().collect())
    lb = sorted(r["b"] for r in cells.select("b").distinct().collect())
    if len(la) != 2 or len(lb) != 2:
        raise ValueError("Fisher's exact test needs a 2x2 table")

    def cnt(x, y):
        return F.sum(F.when((F.col("a") == F.lit(x)) & (F.col("b") == F.lit(y)), F.col("count"))
                     .otherwise(0)).cast("long")
    return cells.agg(cnt(la[0], lb[0]).alias("n11"), cnt(la[0], lb[1]).alias("n12"),
                     cnt(la[1], lb[0]).alias("n21"), cnt(la[1], lb[1]).alias("n22"))


def fisher_test(df: DataFrame, a: str, b: str) -> DataFrame:
    t = two_by_two(df, a, b)
    odds = F.when(F.col("n12") * F.col("n21") == 0,
                  F.when(F.col("n11") * F.col("n22") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
                  ).otherwise(F.col("n11") * F.col("n22") / (F.col("n12") * F.col("n21")))
    return t.select(F.lit("Fisher exact").alias("test"), "n11", "n12", "n21", "n22",
                    odds.alias("statistic"),
                    fisher_pvalue(F.col("n11"), F.col("n12"), F.col("n21"), F.col("n22")).alias("p_value"))


def categorical_association_test(df: DataFrame, a: str, b: str, use_fisher: bool = False) -> DataFrame:
    if use_fisher:
        return fisher_test(df, a, b)
    return chi_square_test(df, a, b)


# ------------------------------------------------------------------ normality

def normality_sample(df: DataFrame, col: str, key: Sequence[str] | None = None,
                     max_n: int = 5000, seed: int = 42) -> list[float]:
    """Up to ``max_n`` non-null values of rows chosen by a keyed hash
    (partition-independent).  The key defaults to all columns; rows with the
    same key and value are counted and each gets a hash of its own."""
    x = q(col).cast("double")
    k = F.xxhash64(F.lit(seed), *[q(c) for c in (key or df.columns)])
    cells = df.where(x.isNotNull()).select(x.alias("x"), k.alias("k")).groupBy("x", "k").agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("k", "copy", "x")
    rows = explode_copies(cells, "n", "copy").select("x", h.alias("h")).orderBy("h", "x").limit(max_n).collect()
    return [r["x"] for r in rows]


def shapiro_test(df: DataFrame, col: str, key: Sequence[str] | None = None, seed: int = 42) -> dict:
    vals = normality_sample(df, col, key, 5000, seed)
    if len(vals) < 3:
        return {"statistic": float("nan"), "p_value": float("nan"), "n": len(vals)}
    w, p = dist.shapiro_wilk(vals)
    return {"statistic": w, "p_value": p, "n": len(vals)}


def dagostino_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    x = q(col).cast("double")
    g = [q(by).alias("group")] if by else []
    return (df.where(x.isNotNull()).groupBy(*g)
            .agg(F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2")))


def dagostino_test(df: DataFrame, col: str) -> dict:
    r = dagostino_stats(df, col).first()
    if r is None or r["n"] < 8:
        return {"statistic": float("nan"), "p_value": float("nan"), "n": 0 if r is None else r["n"]}
    k2, p = dist.dagostino_pearson(r["n"], r["g1"], r["g2"] + 3.0)
    return {"statistic": k2, "p_value": p, "n": r["n"]}


def is_normal(df: DataFrame, col: str, alpha: float = 0.05, key: Sequence[str] | None = None) -> bool:
    """Shapiro-Wilk below 5,000 values, D'Agostino-Pearson above; n < 8 never normal."""
    n = df.where(q(col).isNotNull()).count()
    if n < 8:
        return False
    res = shapiro_test(df, col, key) if n < 5000 else dagostino_test(df, col)
    p = res["p_value"]
    return bool(p == p and p > alpha)


# ---------------------------------------------------------------- related samples

def friedman_stats(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Within-block average ranks (blocks are small: k values each)."""
    base = df.select(q(block).alias("blk"), q(treatment).alias("trt"), q(value).cast("double").alias("v")).dropna()
    wb = Window.partitionBy("blk").orderBy("v")
    wt = Window.partitionBy("blk", "v")
    r = base.select("*", (F.rank().over(wb) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).alias("r"),
                    F.count(F.lit(1)).over(wt).alias("t"))
    ties = r.where(F.col("t") > 1).groupBy("blk", "v").agg(F.first("t").alias("t")).agg(
        F.coalesce(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")), F.lit(0.0)).alias("ties"))
    rs = r.groupBy("trt").agg(F.sum("r").alias("R"))
    nb = base.agg(F.count_distinct("blk").alias("n")).first()["n"]
    k = rs.count()
    tt = ties.first()["ties"]
    st = rs.agg(F.sum(F.pow("R", 2)).alias("ssbn"))
    n, kk = float(nb), float(k)
    c = 1 - tt / (kk * (kk * kk - 1) * n) if k > 1 and nb > 0 else float("nan")
    chisq = (12.0 / (kk * n * (kk + 1)) * F.col("ssbn") - 3 * n * (kk + 1)) / F.lit(c) if k > 1 and nb > 0 \
        else F.lit(None).cast("double")
    return st.select(F.lit(nb).cast("long").alias("n_blocks"), F.lit(k).cast("long").alias("k"),
                     chisq.alias("statistic"), F.lit(k - 1).alias("df1"))


def friedman_test(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    st = friedman_stats(df, block, treatment, value)
    return st.select(F.lit("Friedman").alias("test"), "n_blocks", "k", "statistic",
                     chi2_pvalue(F.col("statistic"), F.col("df1")).alias("p_value"))


def paired_t_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    d = (q(b).cast("double") - q(a).cast("double"))
    dd = df.select(d.alias("d")).dropna()
    st = dd.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    t = F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n")))
    return st.select(F.col("n").cast("long").alias("n"), "mean_diff",
                     F.when(F.col("n") >= 2, t).alias("statistic"), (F.col("n") - 1).alias("df"))


def wilcoxon_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank: zeros dropped, average ranks of |d| from the rank primitive."""
    d = (q(b).cast("double") - q(a).cast("double"))
    dd = df.select(d.alias("d")).dropna()
    nz = dd.where(F.col("d") != 0).select(F.abs("d").alias("ad"), (F.col("d") > 0).alias("pos"))
    vc = nz.groupBy("ad").agg(F.sum(F.col("pos").cast("long")).alias("cp"),
                              F.sum((~F.col("pos")).cast("long")).alias("cn"))
    pos = value_positions(vc.withColumn("cnt", F.col("cp") + F.col("cn")), "ad", weight="cnt")
    j = vc.join(pos.select("ad", "avg_rank", "cnt"), "ad")
    zeros = dd.agg(F.sum((F.col("d") == 0).cast("long")).alias("z")).first()["z"] or 0
    st = j.agg(F.sum(F.col("cp") * F.col("avg_rank")).alias("r_plus"),
               F.sum(F.col("cn") * F.col("avg_rank")).alias("r_minus"),
               F.sum("cnt").alias("n"),
               F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties"))
    return st.select(F.col("n").cast("long").alias("n"), F.lit(zeros).cast("long").alias("zeros"),
                     "r_plus", "r_minus", F.least("r_plus", "r_minus").alias("statistic"), "ties")


def paired_test(df: DataFrame, a: str, b: str, parametric: bool) -> DataFrame:
    """Paired t on b - a, or Wilcoxon signed-rank (exact when small and untied)."""
    if parametric:
        st = paired_t_stats(df, a, b)
        return st.select(F.lit("paired t-test").alias("test"), "n", "statistic",
                         t_pvalue(F.col("statistic"), F.col("df")).alias("p_value"))
    st = wilcoxon_stats(df, a, b)
    n = F.col("n").cast("double")
    mn = n * (n + 1) / 4.0
    se = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = (F.col("statistic") - mn) / F.sqrt(se)
    exact = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    p = F.coalesce(wilcoxon_exact_pvalue(F.col("statistic"), F.when(exact, F.col("n"))), norm_pvalue(z))
    return st.select(F.lit("Wilcoxon signed-rank").alias("test"), "n", "statistic",
                     F.when(F.col("n") >= 1, p).alias("p_value"))


# ------------------------------------------------------------------ helpers

def group_means(df: DataFrame, value: str, group: str) -> DataFrame:
    x = q(value).cast("double")
    return (df.where(x.isNotNull()).groupBy(q(group).alias("group"))
            .agg(F.avg(x).alias("mean"), F.count(x).alias("n")))


def p_adjust(df: DataFrame, p_col: str = "p_value", key: str = "feature") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg columns on a per-feature p-value table.

    The table has one row per tested feature; the rank / reverse cumulative
    minimum windows run over that small table only.
    """
    m = F.count(F.lit(1)).over(Window.partitionBy())
    w_rank = Window.orderBy(F.col(p_col).asc_nulls_last(), F.col(key))
    ranked = df.select("*", F.row_number().over(w_rank).alias("__rank"), m.alias("__m"))
    raw = F.col(p_col) * F.col("__m") / F.col("__rank")
    w_rev = Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select(
        *df.columns, F.least(F.lit(1.0), F.col(p_col) * F.col("__m")).alias("p_bonferroni"),
        F.least(F.lit(1.0), F.min(raw).over(w_rev)).alias("p_fdr_bh"))


def smd(df: DataFrame, value: str, group: str, g1, g2) -> DataFrame:
    """|m1 - m2| / pooled sd (n - 1); NULL below 2 per group; 0 when sd is 0 (op 91)."""
    t = _two(df, value, group, g1, g2)
    v1 = F.when(F.col("first"), F.col("v"))
    v2 = F.when(~F.col("first"), F.col("v"))
    st = t.agg(F.count(v1).alias("n1"), F.count(v2).alias("n2"), F.avg(v1).alias("m1"),
               F.avg(v2).alias("m2"), F.var_samp(v1).alias("s1"), F.var_samp(v2).alias("s2"))
    return smd_from(st)


def smd_from(st: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("s1") + (n2 - 1) * F.col("s2")) / (n1 + n2 - 2))
    val = F.when(pooled == 0, 0.0).otherwise(F.abs(F.col("m1") - F.col("m2")) / pooled)
    return st.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                     F.when((n1 >= 2) & (n2 >= 2), val).alias("smd"))


def missingness_vs_numeric(df: DataFrame, target: str, cols: Sequence[str],
                           parametric: bool) -> DataFrame:
    """Per column with missing values: target mean when missing / present, |Δ| and
    a t or Mann-Whitney test.  Long form by unpivot of null flags; one groupBy."""
    y = q(target).cast("double")
    flags = df.where(y.isNotNull()).select(y.alias("y"), *[q(c).isNull().alias(c) for c in cols])
    long = flags.unpivot("y", list(cols), "column", "missing")
    mom = long.groupBy("column").agg(
        F.avg(F.when(F.col("missing"), F.col("y"))).alias("mean_missing"),
        F.avg(F.when(~F.col("missing"), F.col("y"))).alias("mean_present"),
        F.count(F.when(F.col("missing"), 1)).alias("n_missing"),
        F.count(F.when(~F.col("missing"), 1)).alias("n_present"),
        F.var_samp(F.when(F.col("missing"), F.col("y"))).alias("v1"),
        F.var_samp(F.when(~F.col("missing"), F.col("y"))).alias("v2"))
    n1, n2 = F.col("n_missing"), F.col("n_present")
    keep = mom.where((n1 >= 2) & (n2 >= 2))
    if parametric:
        sp = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
        t = (F.col("mean_missing") - F.col("mean_present")) / F.sqrt(sp * (1.0 / n1 + 1.0 / n2))
        out = keep.select("*", F.lit("t-test (ind.)").alias("test"), t.alias("statistic"),
                          t_pvalue(t, n1 + n2 - 2).alias("p_value"))
    else:
        ranks = value_positions(long.groupBy("column", "y").agg(F.count(F.lit(1)).alias("c")), "y",
                                by=["column"], weight="c")
        cells = long.groupBy("column", "y", "missing").agg(F.count(F.lit(1)).alias("c"))
        rs = (attach(cells, ranks, ["column", "y"], ["avg_rank"]).groupBy("column")
              .agg(F.sum(F.when(F.col("missing"), F.col("c") * F.col("avg_rank"))).alias("r1")))
        ties = ranks.groupBy("column").agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties"))
        k = keep.join(rs, "column").join(ties, "column")
        a, b = n1.cast("double"), n2.cast("double")
        u1 = F.col("r1") - a * (a + 1) / 2
        nn = a + b
        u = F.greatest(u1, a * b - u1)
        sigma = F.sqrt(a * b / 12.0 * ((nn + 1) - F.col("ties") / (nn * (nn - 1))))
        z = (u - a * b / 2.0 - 0.5) / sigma
        out = k.select(*keep.columns, F.lit("Mann-Whitney U").alias("test"), u1.alias("statistic"),
                       F.least(F.lit(1.0), norm_pvalue(z)).alias("p_value"))
    return out.select("column", "mean_missing", "mean_present",
                      F.abs(F.col("mean_missing") - F.col("mean_present")).alias("difference"),
                      "n_missing", "n_present", "test", "statistic", "p_value")


def missingness_vs_class(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Per column: chi-square of (missing, class) and the largest class-share gap."""
    flags = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("y"),
                                                   *[q(c).isNull().alias(c) for c in cols])
    long = flags.unpivot("y", list(cols), "column", "missing")
    cells = long.groupBy("column", "missing", "y").agg(F.count(F.lit(1)).alias("o"))
    w_m = Window.partitionBy("column", "missing")
    w_y = Window.partitionBy("column", "y")
    w_c = Window.partitionBy("column")
    c2 = cells.select("*", F.sum("o").over(w_m).alias("rm"), F.sum("o").over(w_y).alias("cy"),
                      F.sum("o").over(w_c).alias("N"))
    e = F.col("rm") * F.col("cy") / F.col("N")
    share = F.col("o") / F.col("rm")
    per_y = c2.groupBy("column", "y").agg(
        F.sum(F.when(F.col("missing"), share)).alias("sm"), F.sum(F.when(~F.col("missing"), share)).alias("sp"))
    gap = per_y.groupBy("column").agg(F.max(F.abs(F.coalesce("sm", F.lit(0.0)) - F.coalesce("sp", F.lit(0.0))))
                                      .alias("max_class_diff"))
    stat = c2.groupBy("column").agg((F.sum(F.pow(F.col("o"), 2) / e) - F.first("N")).alias("statistic"),
                                    F.count_distinct("missing").alias("R"), F.count_distinct("y").alias("C"))
    dof = (F.col("R") - 1) * (F.col("C") - 1)
    return stat.join(gap, "column").where(F.col("R") == 2).select(
        "column", "max_class_diff", F.lit("chi-squared").alias("test"),
        F.when(dof > 0, F.col("statistic")).alias("statistic"), dof.cast("long").alias("dof"),
        chi2_pvalue(F.col("statistic"), dof).alias("p_value"))
