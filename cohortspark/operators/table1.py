"""Table 1: descriptive statistics overall and by group, with tests (op 92).

One pass per kind of statistic over the *unpivoted* variables, with
``GROUPING SETS ((variable, group), (variable))`` so "Overall" and every group
come from the same scan:

* continuous: count, missing, mean, sd, quartiles (one moment+quantile agg);
* categorical: counts per (variable, level, group) (one count agg);
* normality: Shapiro-Wilk on groups below 5,000 values (those values, by
  definition of the test, go to the driver), D'Agostino-Pearson from moments
  above that;
* tests per variable: t / Mann-Whitney (2 groups) or ANOVA / Kruskal-Wallis,
  chi-square / Fisher for categorical variables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import dist
from cohortspark.functions.columns import q
from cohortspark.functions.quantiles import group_quantiles
from cohortspark.operators import htest

OVERALL = "Overall"


@dataclass(frozen=True)
class Table1Config:
    grouping_var: str | None = None
    continuous_vars: Sequence[str] = field(default_factory=list)
    categorical_vars: Sequence[str] = field(default_factory=list)
    show_pvalues: bool = True
    show_smd: bool = False
    show_missing: bool = True
    normal_test_alpha: float = 0.05
    use_median_iqr_if_skewed: bool = True
    decimal_places: int = 1


def format_pvalue(p: Column) -> Column:
    """<0.001, else 3 dp below .01, else 2 dp; an em dash when missing."""
    return (F.when(p.isNull() | F.isnan(p), "—").when(p < 0.001, "<0.001")
            .when(p < 0.01, F.format_string("%.3f", p)).otherwise(F.format_string("%.2f", p)))


def _long(df: DataFrame, cfg: Table1Config, cols: Sequence[str], cast: str) -> DataFrame:
    g = q(cfg.grouping_var).cast("string") if cfg.grouping_var else F.lit(None).cast("string")
    # rows with a missing group still count in Overall, as in the original table
    base = df.select(g.alias("grp"), *[q(c).cast(cast).alias(c) for c in cols])
    return base.unpivot("grp", list(cols), "variable", "value")


def continuous_stats(df: DataFrame, cfg: Table1Config) -> DataFrame:
    """variable, stratum, n, missing, n_total, mean, sd, q1, median, q3."""
    cols = list(cfg.continuous_vars)
    long = _long(df, cfg, cols, "double")
    x = F.col("value")
    aggs = [F.count(F.lit(1)).alias("n_total"), F.count(x).alias("n"),
            F.sum(x.isNull().cast("long")).alias("missing"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2")]
    if cfg.grouping_var:
        agg = long.groupingSets([["variable", "grp"], ["variable"]], "variable", "grp").agg(
            *aggs, F.grouping("grp").alias("is_overall"))
        agg = agg.where((F.col("is_overall") == 1) | F.col("grp").isNotNull())
        stratum = F.when(F.col("is_overall") == 1, F.lit(OVERALL)).otherwise(F.col("grp"))
    else:
        agg = long.groupBy("variable").agg(*aggs)
        stratum = F.lit(OVERALL)
    strata = [F.lit(OVERALL)] + ([q(cfg.grouping_var).cast("string")] if cfg.grouping_var else [])
    rows = df.select(F.explode(F.array_compact(F.array(*strata))).alias("stratum"), *[q(c).cast("double").alias(c) for c in cols])
    quart = (group_quantiles(rows, {c: q(c) for c in cols}, [0.25, 0.5, 0.75], {"stratum": F.col("stratum")})
             .select(F.col("column").alias("variable"), "stratum", F.col("q").alias("qs")))
    agg = agg.withColumn("stratum", stratum).join(quart, ["variable", "stratum"])
    return agg.select("variable", "stratum", F.col("n_total").cast("long").alias("n_total"),
                      F.col("n").cast("long").alias("n"), F.col("missing").cast("long").alias("missing"),
                      "mean", "sd", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("median"),
                      F.col("qs")[2].alias("q3"), "g1", "g2")


def categorical_counts(df: DataFrame, cfg: Table1Config) -> DataFrame:
    """variable, stratum, level, count, pct of non-null in stratum, missing."""
    cols = list(cfg.categorical_vars)
    long = _long(df, cfg, cols, "string")
    if cfg.grouping_var:
        agg = (long.groupingSets([["variable", "grp", "value"], ["variable", "value"]], "variable", "grp", "value")
               .agg(F.count(F.lit(1)).alias("count"), F.grouping("grp").alias("is_overall")))
        agg = agg.where((F.col("is_overall") == 1) | F.col("grp").isNotNull())
        stratum = F.when(F.col("is_overall") == 1, F.lit(OVERALL)).otherwise(F.col("grp"))
    else:
        agg = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
        stratum = F.lit(OVERALL)
    cells = agg.select("variable", stratum.alias("stratum"), F.col("value").alias("level"),
                       F.col("count").cast("long").alias("count"))
    # per stratum totals from the same (small) count table
    tot = cells.groupBy("variable", "stratum").agg(
        F.sum(F.when(F.col("level").isNotNull(), F.col("count")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("level").isNull(), F.col("count")).otherwise(0)).alias("missing"),
        F.sum("count").alias("n_total"))
    return cells.join(tot, ["variable", "stratum"]).select(
        "variable", "stratum", "level", "count",
        F.when(F.col("level").isNotNull(), F.col("count") * 100.0 / F.col("non_null")).alias("pct"),
        F.col("missing").cast("long").alias("missing"), F.col("n_total").cast("long").alias("n_total"))


def _normality(df: DataFrame, cfg: Table1Config, stats: DataFrame) -> dict:
    """(variable, stratum) -> normal?  Shapiro below 5,000 values, K² above."""
    rows = stats.select("variable", "stratum", "n", "g1", "g2").collect()
    out = {}
    small = [(r["variable"], r["stratum"]) for r in rows if 8 <= r["n"] < 5000]
    samples: dict = {}
    if small:
        long = _long(df, cfg, list(cfg.continuous_vars), "double").where(F.col("value").isNotNull())
        strata = F.array(F.lit(OVERALL), F.col("grp")) if cfg.grouping_var else F.array(F.lit(OVERALL))
        ex = long.select("variable", F.explode(strata).alias("stratum"), "value").where(F.col("stratum").isNotNull())
        keys = F.concat_ws("\u0001", "variable", "stratum")
        keyset = [f"{v}\u0001{s}" for v, s in small]
        # each kept group holds < 5,000 values by construction
        for r in ex.where(keys.isin(keyset)).groupBy("variable", "stratum").agg(
                F.collect_list("value").alias("vals")).collect():
            samples[(r["variable"], r["stratum"])] = r["vals"]
    for r in rows:
        key = (r["variable"], r["stratum"])
        alpha = cfg.normal_test_alpha if r["stratum"] == OVERALL else 0.05
        if r["n"] < 8:
            out[key] = False
        elif r["n"] < 5000:
            _w, p = dist.shapiro_wilk(samples.get(key, []))
            out[key] = bool(p == p and p > alpha)
        else:
            _k, p = dist.dagostino_pearson(r["n"], r["g1"], r["g2"] + 3.0)
            out[key] = bool(p == p and p > alpha)
    return out


def generate_table1(df: DataFrame, cfg: Table1Config) -> tuple[DataFrame, DataFrame]:
    """Returns (cells, tests).

    cells: variable, row_label, stratum, level, n, statistics and the formatted
    cell text; tests: variable, test, statistic, p_value, p_text, smd.
    """
    spark = df.sparkSession
    dp = cfg.decimal_places
    pieces = []
    tests = []
    groups: list = []
    if cfg.grouping_var:
        groups = sorted((r[0] for r in df.where(q(cfg.grouping_var).isNotNull())
                         .select(q(cfg.grouping_var).cast("string")).distinct().collect()), key=str)
    if cfg.continuous_vars:
        st = continuous_stats(df, cfg).cache()
        normal = _normality(df, cfg, st)
        med_vars = {v for v in cfg.continuous_vars
                    if cfg.use_median_iqr_if_skewed and not normal.get((v, OVERALL), False)}
        use_med = F.col("variable").isin(list(med_vars)) if med_vars else F.lit(False)
        text = F.when(F.col("n") == 0, "—").when(
            use_med, F.format_string(f"%.{dp}f [%.{dp}f, %.{dp}f]", "median", "q1", "q3")).otherwise(
            F.format_string(f"%.{dp}f ± %.{dp}f", "mean", "sd"))
        label = F.concat(F.col("variable"), F.when(use_med, F.lit(", median [IQR]")).otherwise(F.lit(", mean ± SD")))
        pieces.append(st.select("variable", label.alias("row_label"), "stratum", F.lit(None).cast("string").alias("level"),
                                "n", "mean", "sd", "q1", "median", "q3", F.lit(None).cast("long").alias("count"),
                                F.lit(None).cast("double").alias("pct"), text.alias("text")))
        if cfg.show_missing:
            miss_vars = [r["variable"] for r in st.where((F.col("stratum") == OVERALL) & (F.col("missing") > 0))
                         .select("variable").collect()]
            if miss_vars:
                m = st.where(F.col("variable").isin(miss_vars))
                pieces.append(m.select("variable", F.lit("  Missing").alias("row_label"), "stratum",
                                       F.lit(None).cast("string").alias("level"), F.col("missing").alias("n"),
                                       *[F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "q1", "median", "q3")],
                                       F.col("missing").alias("count"),
                                       (F.col("missing") * 100.0 / F.col("n_total")).alias("pct"),
                                       F.format_string("%d (%.1f%%)", F.col("missing"),
                                                       F.col("missing") * 100.0 / F.col("n_total")).alias("text")))
        if cfg.grouping_var and cfg.show_pvalues and len(groups) >= 2:
            for v in cfg.continuous_vars:
                present = [g for g in groups if (v, g) in normal]
                all_norm = all(normal.get((v, g), False) for g in present)
                if len(present) == 2:
                    t = htest.two_sample_test(df, v, cfg.grouping_var, present[0], present[1], all_norm).first()
                elif len(present) > 2:
                    sub = df.where(q(cfg.grouping_var).isin(present))
                    t = htest.k_sample_test(sub, v, cfg.grouping_var, all_norm).first()
                else:
                    t = None
                smd = None
                if cfg.show_smd and len(groups) == 2:
                    smd = htest.smd(df, v, cfg.grouping_var, groups[0], groups[1]).first()["smd"]
                tests.append((v, t["test"] if t else None, t["statistic"] if t else None,
                              t["p_value"] if t else None, smd))
    if cfg.categorical_vars:
        cc = categorical_counts(df, cfg).cache()
        lv = cc.where(F.col("level").isNotNull())
        pieces.append(lv.select("variable", F.concat(F.lit("  "), F.col("level")).alias("row_label"), "stratum",
                                "level", F.lit(None).cast("long").alias("n"),
                                *[F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "q1", "median", "q3")],
                                "count", "pct",
                                F.format_string("%d (%.1f%%)", "count", "pct").alias("text")))
        if cfg.show_missing:
            mi = cc.where(F.col("level").isNull() & (F.col("count") > 0))
            miss_vars = [r["variable"] for r in mi.where(F.col("stratum") == OVERALL).select("variable").collect()]
            if miss_vars:
                pieces.append(mi.where(F.col("variable").isin(miss_vars)).select(
                    "variable", F.lit("  Missing").alias("row_label"), "stratum", F.lit(None).cast("string").alias("level"),
                    F.col("count").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "q1", "median", "q3")],
                    "count", (F.col("count") * 100.0 / F.col("n_total")).alias("pct"),
                    F.format_string("%d (%.1f%%)", F.col("count"), F.col("count") * 100.0 / F.col("n_total")).alias("text")))
        if cfg.grouping_var and cfg.show_pvalues and len(groups) >= 2:
            for v in cfg.categorical_vars:
                tab = htest.contingency_table(df, v, cfg.grouping_var)
                dims = tab.agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"),
                               F.min("count").alias("mn")).first()
                small = dims["r"] <= 2 and dims["c"] <= 2
                # absent cells are zero counts
                if small and dims["r"] * dims["c"] < 4:
                    small_min = 0
                else:
                    small_min = dims["mn"]
                if dims["r"] == 2 and dims["c"] == 2 and small_min is not None and small_min < 5:
                    t = htest.fisher_test(df, v, cfg.grouping_var).first()
                elif dims["r"] >= 2 and dims["c"] >= 2:
                    t = htest.chi_square_test(df, v, cfg.grouping_var).first()
                else:
                    t = None
                tests.append((v, t["test"] if t else None, t["statistic"] if t else None,
                              t["p_value"] if t else None, None))
    if not pieces:
        empty = spark.createDataFrame([], "variable string, row_label string, stratum string, text string")
        return empty, spark.createDataFrame([], "variable string, test string, statistic double, p_value double, smd double")
    cells = pieces[0]
    for p in pieces[1:]:
        cells = cells.unionByName(p)
    tdf = spark.createDataFrame(tests, "variable string, test string, statistic double, p_value double, smd double")
    tdf = tdf.withColumn("p_text", format_pvalue(F.col("p_value")))
    return cells, tdf
