"""Feature, target and dataset profiles and the EDA tables built from them
(ops 43-59).  Every per-column statistic for all columns is one fused
aggregation; outlier counts are a second fused pass with literal bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.aggs import by_column, distinct_counts, scalar_quantiles, unpivot_stats, wide_agg
from cohortspark.functions.quantiles import group_quantiles
from cohortspark.session import written
from cohortspark.functions.columns import (categorical_cols, is_categorical_type,
                                           is_datetime_type, is_integral_type, is_numeric_type,
                                           kurt_g2, numeric_cols, q, skew_g1)
from cohortspark.functions.topk import top_k_per_group
from cohortspark.operators.outliers import Bounds, fit_bounds, flag_expr

# ------------------------------------------------------------ feature profile (43)


def feature_profile(df: DataFrame, cols: Sequence[str] | None = None,
                    outlier_method: str = "iqr", approx_distinct: bool = False,
                    quantile_method: str = "exact") -> DataFrame:
    """One row per feature: missing, unique, ratios, flags, moments, outliers.

    numeric: mean, sd (n-1), min, max, median, skew G1 (n > 2), outlier count
    and rate (of non-null), has_outliers (> 1 %).  categorical (string/bool or
    <= 10 levels is *not* categorical for numeric columns): high-cardinality
    flag (ratio > .5 or > 50 levels).
    """
    cols = list(cols) if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric_type(types[c])]
    medians: dict = {}
    if num and outlier_method == "iqr":
        # the same selection gives the IQR bounds and the medians
        quart = scalar_quantiles(df, num, [0.25, 0.5, 0.75], quantile_method)
        counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(num)]).first()
        bounds = {}
        for i, c in enumerate(num):
            qs, n_c = quart[c], int(counts[f"n{i}"] or 0)
            medians[c] = qs[1]
            iqr = qs[2] - qs[0] if qs[0] is not None else 0.0
            bounds[c] = (Bounds("iqr", n_c, qs[0] - 1.5 * iqr, qs[2] + 1.5 * iqr) if n_c >= 3 and iqr != 0
                         else Bounds("iqr", n_c))
    else:
        bounds = fit_bounds(df, num, outlier_method, quantile_method=quantile_method) if num else {}
        medians = {c: v[0] for c, v in scalar_quantiles(df, num, [0.5], quantile_method).items()}
    if approx_distinct:
        urow = df.agg(*[F.approx_count_distinct(q(c)).alias(f"u{i}") for i, c in enumerate(cols)]).first()
        unique = {c: int(urow[f"u{i}"]) for i, c in enumerate(cols)}
    else:
        unique = distinct_counts(df, cols)
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = q(c)
        exprs += [F.sum(x.isNull().cast("long")).alias(f"c{i}_miss"),
                  F.lit(unique[c]).cast("long").alias(f"c{i}_uniq")]
        if c in bounds:
            d = x.cast("double")
            exprs += [F.count(x).alias(f"c{i}_nn"), F.avg(d).alias(f"c{i}_mean"),
                      F.stddev_samp(d).alias(f"c{i}_std"), F.min(d).alias(f"c{i}_min"),
                      F.max(d).alias(f"c{i}_max"),
                      F.lit(medians[c]).cast("double").alias(f"c{i}_med"),
                      F.skewness(d).alias(f"c{i}_g1"),
                      F.sum(flag_expr(c, bounds[c]).cast("long")).alias(f"c{i}_out")]
    row = df.agg(*exprs)
    n = F.col("__n")
    structs = []
    null_d = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        is_num = c in bounds
        miss, uniq = F.col(f"c{i}_miss"), F.col(f"c{i}_uniq")
        ratio = F.when(n > 0, uniq / n).otherwise(0.0)
        id_like = (uniq == n) & F.lit(is_num and is_integral_type(types[c]))
        if is_num:
            nn = F.col(f"c{i}_nn")
            out = F.coalesce(F.col(f"c{i}_out"), F.lit(0))
            rate = F.when(nn > 0, out / nn)
            num_part = [F.col(f"c{i}_mean"), F.col(f"c{i}_std"), F.col(f"c{i}_min"),
                        F.col(f"c{i}_max"), F.col(f"c{i}_med"), skew_g1(F.col(f"c{i}_g1"), nn),
                        F.when(nn > 0, out).cast("long"), rate, F.when(nn > 0, rate > 0.01)]
            high_card = F.lit(None).cast("boolean")
        else:
            num_part = [null_d] * 6 + [F.lit(None).cast("long"), null_d, F.lit(None).cast("boolean")]
            high_card = (ratio > 0.5) | (uniq > 50)
        names = ["mean", "std", "min", "max", "median", "skewness", "outlier_count",
                 "outlier_rate", "has_outliers"]
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"),
            F.lit(is_num).alias("is_numeric"),
            miss.cast("long").alias("missing_count"),
            F.when(n > 0, miss / n).otherwise(0.0).alias("missing_rate"),
            uniq.cast("long").alias("unique_count"), ratio.alias("cardinality_ratio"),
            (uniq <= 1).alias("is_constant"), id_like.alias("is_id_like"),
            *[e.alias(nm) for e, nm in zip(num_part, names)],
            high_card.alias("is_high_cardinality")))
    return row.select(F.inline(F.array(*structs)))


def top_categories(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Top-k levels per categorical column: (column, level, count, rank).

    Long form by unpivot, counts by (column, level) with map-side combining,
    then a salted two-stage top-k so one huge column never sits in one task.
    Ties are broken by the level text.
    """
    cols = list(cols) if cols is not None else categorical_cols(df)
    long = df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "level").where(F.col("level").isNotNull())
    counts = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(counts, ["column"], [F.desc("count"), F.asc("level")], k,
                           salt_on=["level"])


# ------------------------------------------------------------- target profiles (44, 45)

def target_profile_regression(df: DataFrame, target: str, outlier_method: str = "iqr") -> DataFrame:
    """n_unique, mean, sd, min, max, median, skew G1, outlier rate, has_outliers (> 5 %)."""
    b = fit_bounds(df, [target], outlier_method)[target]
    median = scalar_quantiles(df, [target], [0.5])[target][0]
    x = q(target).cast("double")
    row = df.agg(F.count_distinct(q(target)).alias("n_unique"), F.count(x).alias("n"),
                 F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                 F.max(x).alias("max"), F.lit(median).cast("double").alias("median"),
                 F.skewness(x).alias("g1"),
                 F.sum(flag_expr(target, b).cast("long")).alias("n_out"))
    rate = F.when(F.col("n") > 0, F.coalesce(F.col("n_out"), F.lit(0)) / F.col("n")).otherwise(0.0)
    return row.select(F.lit(target).alias("target"), F.col("n_unique").cast("long").alias("n_unique"),
                      "mean", "std", "min", "max", "median",
                      skew_g1(F.col("g1"), F.col("n")).alias("skewness"),
                      rate.alias("outlier_rate"), (rate > 0.05).alias("has_outliers"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return (df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("class"))
            .agg(F.count(F.lit(1)).alias("count")))


def target_profile_classes(df: DataFrame, target: str) -> DataFrame:
    """Class counts with max/min ratio, minority size and imbalance severity."""
    cc = class_counts(df, target)
    s = cc.agg(F.count(F.lit(1)).alias("n_classes"), F.max("count").alias("max_count"),
               F.min("count").alias("min_count"), F.sum("count").alias("n"))
    ratio = F.col("max_count") / F.col("min_count")
    sev = (F.when(ratio > 10, "severe").when(ratio > 5, "moderate").when(ratio > 2, "mild")
           .otherwise("none"))
    return s.select(F.lit(target).alias("target"), F.col("n_classes").cast("long").alias("n_classes"),
                    F.col("max_count").cast("long").alias("max_count"),
                    F.col("min_count").cast("long").alias("minority_class_size"),
                    ratio.alias("class_balance_ratio"), (ratio > 2).alias("is_imbalanced"),
                    sev.alias("imbalance_severity"))


# -------------------------------------------------------------- task type (49)

def detect_task_type(df: DataFrame, target: str) -> DataFrame:
    """regression / classification with confidence from dtype and cardinality."""
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[target]
    x = q(target)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("u"),
                 F.min(x).alias("mn") if is_numeric_type(dt) else F.lit(None).alias("mn"),
                 F.max(x).alias("mx") if is_numeric_type(dt) else F.lit(None).alias("mx"))
    u, n = F.col("u"), F.col("n")
    ratio = F.when(n > 0, u / n).otherwise(0.0)
    if is_categorical_type(dt):
        det, conf = F.lit("classification"), F.lit("high")
    elif is_integral_type(dt):
        binary = (u == 2) & (F.col("mn") == 0) & (F.col("mx") == 1)
        det = F.when(binary | (u <= 10) | (ratio < 0.02), "classification").otherwise("regression")
        conf = (F.when(binary, "high").when(u <= 10, F.when(u <= 5, "med").otherwise("low"))
                .otherwise("med"))
    elif is_numeric_type(dt):
        det = F.when((u <= 10) | (ratio < 0.02), "classification").otherwise("regression")
        conf = F.when(u <= 10, "med").when(ratio < 0.02, "low").otherwise("high")
    else:
        det, conf = F.lit("regression"), F.lit("low")
    return row.select(F.lit(target).alias("target"), u.cast("long").alias("n_unique"),
                      ratio.alias("unique_ratio"), det.alias("detected"), conf.alias("confidence"))


# ---------------------------------------------------- dataset profile (46-48)

# Sufficiency levels from worst to best.
SUFFICIENCY_LEVELS = ("critical", "scarce", "limited", "adequate", "abundant")


def _level_index(c: Column) -> Column:
    m = F.create_map(*[x for i, lv in enumerate(SUFFICIENCY_LEVELS) for x in (F.lit(lv), F.lit(i))])
    return m[c]


def _level_name(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(lv) for lv in SUFFICIENCY_LEVELS]), i + 1)


def sufficiency_expr(n: Column, p: Column, task: Column, minority: Column) -> Column:
    """Data-sufficiency level; p/n and EPV checks can only downgrade (op 47)."""
    base = (F.when(n < 50, 0).when(n < 100, 1).when(n < 500, 2).when(n < 5000, 3).otherwise(4))
    pn = F.when(n > 0, p / n)
    cap_pn = F.when(pn.isNull() | (pn > 1.0), 0).when(pn > 0.5, 1).otherwise(4)
    epv = F.when(p > 0, minority / p)
    cap_epv = F.when((task == "classification") & minority.isNotNull(),
                     F.when(epv < 5, 0).when(epv < 10, 1).otherwise(4)).otherwise(4)
    return _level_name(F.least(base, cap_pn, cap_epv))


def dataset_profile(df: DataFrame, target: str | None = None,
                    features: Sequence[str] | None = None, task_type: str | None = None) -> DataFrame:
    """One-row dataset profile: n, p, p/n, missingness counts, task, EPV, level."""
    features = list(features) if features is not None else [c for c in df.columns if c != target]
    p = len(features)
    if not df.columns or df.limit(1).count() == 0:
        raise ValueError("cannot profile an empty table")
    exprs = [F.count(F.lit(1)).alias("n")]
    exprs += [F.sum(q(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(features)]
    if target:
        exprs.append(F.count_distinct(q(target)).alias("t_unique"))
    row = df.agg(*exprs)
    n = F.col("n")
    if p == 0:
        raise ValueError("no feature columns")
    miss = [F.col(f"m{i}") for i in range(p)]
    tot = sum(miss[1:], miss[0])
    n_with = sum([(m > 0).cast("long") for m in miss], F.lit(0).cast("long"))
    n_high = sum([(m / n > 0.1).cast("long") for m in miss], F.lit(0).cast("long"))
    n_crit = sum([(m / n > 0.5).cast("long") for m in miss], F.lit(0).cast("long"))
    if target and task_type is None:
        task = F.when((F.col("t_unique") <= 20) & (F.col("t_unique") < n * 0.05),
                      "classification").otherwise("regression")
    else:
        task = F.lit(task_type or "regression")
    minority = F.lit(None).cast("long")
    prof = row.select(n.cast("long").alias("n_rows"), F.lit(p).cast("long").alias("n_features"),
                      (F.lit(p) / n).alias("p_n_ratio"),
                      (tot / (n * p)).alias("total_missing_rate"),
                      n_with.alias("n_features_missing"), n_high.alias("n_features_high_missing"),
                      n_crit.alias("n_features_critical_missing"), task.alias("task_type"))
    if target:
        # one scalar: smallest class size (class table is O(levels))
        mino = class_counts(df, target).agg(F.min("count").alias("m")).first()["m"]
        minority = F.when(F.col("task_type") == "classification", F.lit(mino))
    prof = prof.withColumn("minority_class_size", minority.cast("long"))
    return prof.select(
        *prof.columns,
        F.when(F.col("minority_class_size").isNotNull(),
               F.col("minority_class_size") / F.col("n_features")).alias("events_per_variable"),
        sufficiency_expr(F.col("n_rows"), F.col("n_features"), F.col("task_type"),
                         F.col("minority_class_size")).alias("sufficiency"))


def data_warnings(profile: DataFrame, features: DataFrame | None = None,
                  target_classes: DataFrame | None = None) -> DataFrame:
    """Warning rows (category, level, count) from the profile tables (op 48)."""
    p = profile.first()
    rows = []
    if p["n_rows"] < 100:
        rows.append(("sample_size", "critical", int(p["n_rows"])))
    elif p["n_rows"] < 500:
        rows.append(("sample_size", "warning", int(p["n_rows"])))
    if p["p_n_ratio"] > 0.5:
        rows.append(("dimensionality", "warning" if p["p_n_ratio"] <= 1.0 else "critical",
                     int(p["n_features"])))
    if target_classes is not None:
        t = target_classes.first()
        if t and t["is_imbalanced"]:
            lv = {"severe": "critical", "moderate": "warning"}.get(t["imbalance_severity"], "caution")
            rows.append(("imbalance", lv, int(t["minority_class_size"])))
    if p["n_features_high_missing"] > 0:
        rows.append(("missingness", "critical" if p["n_features_critical_missing"] > 0 else "warning",
                     int(p["n_features_high_missing"])))
    if features is not None:
        f = features.agg(F.sum(F.coalesce(F.col("is_high_cardinality"), F.lit(False)).cast("long")).alias("hc"),
                         F.sum(F.coalesce(F.col("has_outliers"), F.lit(False)).cast("long")).alias("ho")).first()
        if f["hc"]:
            rows.append(("cardinality", "caution", int(f["hc"])))
        if f["ho"]:
            rows.append(("outliers", "caution", int(f["ho"])))
    spark = profile.sparkSession
    return spark.createDataFrame(rows, "category string, level string, count long")


# ------------------------------------------------------ cohort structure (50, 51)

# Entity-id name patterns, clinical names excluded, time name patterns.
ENTITY_PATTERNS = ("id", "patient", "subject", "participant", "person", "user", "member",
                   "customer", "account", "entity", "record", "mrn", "seqn")
CLINICAL_NAMES = ("glucose", "bmi", "weight", "height", "age", "bp", "cholesterol",
                  "hba1c", "triglyceride", "waist", "kcal")
TIME_PATTERNS = ("date", "time", "visit", "day", "week", "month", "year", "ts", "timestamp")


def rows_per_entity(df: DataFrame, entity: str, bins: int = 20) -> DataFrame:
    """Two-level groupBy: rows per entity, then the histogram of those counts."""
    per = df.groupBy(q(entity)).agg(F.count(F.lit(1)).alias("rows"))
    s = per.agg(F.min("rows").alias("mn"), F.max("rows").alias("mx"))
    return histogram(per, "rows", bins, bounds=s.first())


def entity_summary(df: DataFrame, entity: str) -> DataFrame:
    """entities, median and mean rows per entity, repeat share, design guess."""
    # entities per number of rows: small, and enough for every statistic
    sizes = written(df.where(q(entity).isNotNull()).groupBy(q(entity)).agg(F.count(F.lit(1)).alias("rows")), "entity-rows")
    median = scalar_quantiles(sizes, ["rows"], [0.5])["rows"][0]
    s = sizes.agg(F.count(F.lit(1)).alias("entities"), F.lit(median).cast("double").alias("median_rows"),
                F.avg("rows").alias("mean_rows"),
                F.avg((F.col("rows") > 1).cast("double")).alias("repeat_share"))
    return s.select(F.lit(entity).alias("entity"), F.col("entities").cast("long").alias("entities"),
                    "median_rows", "mean_rows", "repeat_share",
                    F.when((F.col("median_rows") > 1) | (F.col("repeat_share") > 0.2), "longitudinal")
                     .otherwise("cross_sectional").alias("design"))


def cohort_structure(df: DataFrame) -> DataFrame:
    """Entity-id and time candidates by name/type, scored on the data (op 50).

    One fused agg gives unique ratio per candidate; the longitudinal decision
    uses ``entity_summary`` on the best candidate.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    ents = [c for c in df.columns
            if any(p in c.lower() for p in ENTITY_PATTERNS)
            and not any(k in c.lower() for k in CLINICAL_NAMES)
            and (is_integral_type(types[c]) or isinstance(types[c], T.StringType))]
    times = [c for c in df.columns
             if is_datetime_type(types[c]) or any(p in c.lower() for p in TIME_PATTERNS)]
    cands = [(c, "entity") for c in ents] + [(c, "time") for c in times if c not in ents]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, role string, unique_ratio double")
    unique = distinct_counts(df, [c for c, _ in cands])
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.lit(unique[c]).cast("long").alias(f"c{i}__u") for i, (c, _r) in enumerate(cands)])
    long = unpivot_stats(row, [c for c, _ in cands], ["u"], keep=["__n"])
    roles = F.create_map(*[x for c, r in cands for x in (F.lit(c), F.lit(r))])
    return long.select("column", roles[F.col("column")].alias("role"),
                       (F.col("u") / F.col("__n")).alias("unique_ratio"))


# ----------------------------------------------------------- signals (52, 53)

def column_signals(df: DataFrame) -> DataFrame:
    """Per column: class (numeric / categorical / datetime / text-like), missing
    rate, high-missing (> 5 %), high-cardinality categorical (> .5 n)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = df.columns
    row = wide_agg(df, cols, {"miss": lambda c: F.sum(c.isNull().cast("long"))},
                   extra=[F.count(F.lit(1)).alias("__n")])
    long = unpivot_stats(row, cols, ["miss"], keep=["__n"]).withColumn("u", by_column(distinct_counts(df, cols), "long"))
    kind = {c: ("numeric" if is_numeric_type(t) else "datetime" if is_datetime_type(t)
                else "bool" if isinstance(t, T.BooleanType)
                else "string" if isinstance(t, T.StringType) else "other")
            for c, t in types.items()}
    kmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kind[c]))])
    k = kmap[F.col("column")]
    n = F.col("__n")
    cls = (F.when(k == "string", F.when(F.col("u") / n > 0.8, "text_like").otherwise("categorical"))
           .when(k == "bool", "categorical").otherwise(k))
    mr = F.col("miss") / n
    return long.select("column", cls.alias("column_class"), mr.alias("missing_rate"),
                       (mr > 0.05).alias("high_missing"),
                       ((cls == "categorical") & (F.col("u") > n * 0.5)).alias("high_cardinality"))


def duplicate_row_rate(df: DataFrame) -> DataFrame:
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("k"))
    return g.agg((F.sum(F.col("k") - 1) / F.sum("k")).alias("duplicate_row_rate"))


def target_signals(df: DataFrame, target: str, task_type: str, outlier_method: str = "iqr") -> DataFrame:
    """Regression: unique, missing, mean, median, sd, population skew/kurtosis,
    outlier rate.  Classes: counts, min/max ratio, majority share."""
    x = q(target)
    if task_type == "regression":
        b = fit_bounds(df, [target], outlier_method)[target]
        d = x.cast("double")
        median = scalar_quantiles(df, [target], [0.5])[target][0]
        return df.agg(
            F.count_distinct(x).cast("long").alias("n_unique"),
            F.sum(x.isNull().cast("long")).cast("long").alias("n_missing"),
            (F.sum(x.isNull().cast("long")) / F.count(F.lit(1))).alias("missing_rate"),
            F.avg(d).alias("mean"), F.lit(median).cast("double").alias("median"),
            F.stddev_samp(d).alias("std"), F.skewness(d).alias("skew"), F.kurtosis(d).alias("kurtosis"),
            (F.sum(flag_expr(target, b).cast("long")) / F.count(x)).alias("outlier_rate"))
    cc = class_counts(df, target)
    return cc.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                  (F.min("count") / F.max("count")).alias("class_imbalance_ratio"),
                  (F.max("count") / F.sum("count")).alias("majority_class_prop"))


# -------------------------------------------------------------- histogram (54)

def histogram(df: DataFrame, col: str, bins: int = 30, bounds=None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed): bin, lo, hi, count."""
    x = q(col).cast("double")
    if bounds is None:
        bounds = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mn, mx = bounds["mn"], bounds["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    mn, mx = float(mn), float(mx)
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


# ------------------------------------------------------- box by group (55, 104)

def box_by_group(df: DataFrame, value: str, group: str | None = None,
                 tertile_of: str | None = None) -> DataFrame:
    """Five numbers of ``value`` per category of ``group`` or per tertile
    (Low / Mid / High) of a numeric column."""
    x = q(value).cast("double")
    if tertile_of is not None:
        t = q(tertile_of).cast("double")
        qs = scalar_quantiles(df, [tertile_of], [1 / 3, 2 / 3])[tertile_of]
        g = (F.when(t <= F.lit(qs[0]), "Low").when(t <= F.lit(qs[1]), "Mid").when(t.isNotNull(), "High"))
    else:
        g = q(group).cast("string")
    rows = df.where(x.isNotNull() & g.isNotNull()).select(g.alias("group"), x.alias("x"))
    means = rows.groupBy("group").agg(F.avg("x").alias("mean"))
    five = group_quantiles(rows, {"x": F.col("x")}, [0.0, 0.25, 0.5, 0.75, 1.0], {"group": F.col("group")})
    return five.join(means, "group").select(
        "group", "n", *[F.col("q")[k].alias(name) for k, name in enumerate(("min", "q1", "median", "q3", "max"))], "mean")


# ---------------------------------------------------------- class balance (56)

def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts per class, majority share (majority-class accuracy), warning < .5."""
    cc = class_counts(df, target)
    w = Window.partitionBy()  # over the (tiny) class table only
    return cc.select("class", "count", (F.col("count") / F.sum("count").over(w)).alias("share"),
                     (F.max("count").over(w) / F.sum("count").over(w)).alias("majority_baseline"),
                     (F.min("count").over(w) / F.max("count").over(w) < 0.5).alias("imbalance_warning"))


# ------------------------------------------------------- scaling / n:p (57, 58)

def scaling_check(df: DataFrame, cols: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """min, max, sd of the numeric columns (of the first ``limit`` if given)."""
    cols = (list(cols) if cols is not None else numeric_cols(df))[:limit]
    row = wide_agg(df, cols, {"min": lambda c: F.min(c).cast("double"),
                              "max": lambda c: F.max(c).cast("double"),
                              "std": lambda c: F.stddev_samp(c.cast("double"))})
    long = unpivot_stats(row, cols, ["min", "max", "std"])
    return long.select("column", "min", "max", "std", (F.col("max") - F.col("min")).alias("range"))


def np_sufficiency(df: DataFrame, features: Sequence[str]) -> DataFrame:
    p = len(features)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").cast("long").alias("n"), F.lit(p).cast("long").alias("p"),
        (F.col("n") / F.lit(p)).alias("n_per_p"), (F.col("n") / F.lit(p) < 20).alias("warn"))


# -------------------------------------------------------- exclusion flow (59)

def exclusion_flow(df: DataFrame, reasons: Sequence[tuple[str, Column]], target: str | None = None,
                   split_col: str | None = None) -> DataFrame:
    """Counts along total -> excluded (first matching reason) -> missing target ->
    analysed -> split parts.  One groupBy over a ``when`` chain."""
    stage = None
    for name, cond in reasons:
        stage = (F.when(cond, F.lit(f"excluded:{name}")) if stage is None
                 else stage.when(cond, F.lit(f"excluded:{name}")))
    if target is not None:
        tcond = q(target).isNull()
        stage = F.when(tcond, "missing_target") if stage is None else stage.when(tcond, "missing_target")
    part = F.concat(F.lit("analysed:"), q(split_col).cast("string")) if split_col else F.lit("analysed")
    stage = part if stage is None else stage.otherwise(part)
    return df.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("count"))
