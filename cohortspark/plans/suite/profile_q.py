"""Profile, outlier and plausibility computations (ops 43-69b)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import outliers, plausibility, profile
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rcol, rounded, table, union_sql

LI_PROF = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
_T = {"l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
      "l_discount": "double", "l_tax": "double", "l_returnflag": "string"}


def _iqr_bounds_sql(c, src):
    return (f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi, "
            f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, count({c}) AS nb FROM {src})")


def _feat_sql(c, src="lineitem"):
    if _T[c] == "string":
        return f"""SELECT '{c}' AS "column", 'string' AS dtype, false AS is_numeric,
  CAST(sum(({c} IS NULL)::INT) AS BIGINT) AS missing_count, {r(f"sum(({c} IS NULL)::INT) / count(*)")} AS missing_rate,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, {r(f"count(DISTINCT {c}) / count(*)")} AS cardinality_ratio,
  count(DISTINCT {c}) <= 1 AS is_constant, false AS is_id_like,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
  CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS skewness, CAST(NULL AS BIGINT) AS outlier_count,
  CAST(NULL AS DOUBLE) AS outlier_rate, CAST(NULL AS BOOLEAN) AS has_outliers,
  (count(DISTINCT {c}) / count(*) > 0.5 OR count(DISTINCT {c}) > 50) AS is_high_cardinality
FROM {src}"""
    out = f"sum(CASE WHEN nb >= 3 AND iqr <> 0 AND ({c} < lo OR {c} > hi) THEN 1 ELSE 0 END)"
    idl = "count(DISTINCT {c}) = count(*)".format(c=c) if _T[c] == "int" else "false"
    return f"""SELECT '{c}' AS "column", '{_T[c]}' AS dtype, true AS is_numeric,
  CAST(sum(({c} IS NULL)::INT) AS BIGINT) AS missing_count, {r(f"sum(({c} IS NULL)::INT) / count(*)")} AS missing_rate,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, {r(f"count(DISTINCT {c}) / count(*)")} AS cardinality_ratio,
  count(DISTINCT {c}) <= 1 AS is_constant, {idl} AS is_id_like,
  {r(f"avg({c})")} AS mean, {r(f"stddev_samp({c})")} AS std, {r(f"min({c})")} AS min, {r(f"max({c})")} AS max,
  {r(f"quantile_cont({c}, 0.5)")} AS median, {r(f"skewness({c})")} AS skewness,
  CAST({out} AS BIGINT) AS outlier_count, {r(f"{out} / count({c})")} AS outlier_rate,
  {out} / count({c}) > 0.01 AS has_outliers, CAST(NULL AS BOOLEAN) AS is_high_cardinality
FROM {src}, {_iqr_bounds_sql(c, src)} b GROUP BY lo, hi, iqr, nb"""


@register("profile_features", union_sql([_feat_sql(c) for c in LI_PROF]))
def q_features(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(profile.feature_profile(li, LI_PROF))


@register("profile_top_categories", """
SELECT "column", level, count, rank FROM (
  SELECT "column", level, count(*) AS count,
         row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, level) AS rank
  FROM (UNPIVOT (SELECT o_orderstatus, o_orderpriority, CAST(o_custkey % 97 AS VARCHAR) AS cust_bucket FROM orders)
        ON o_orderstatus, o_orderpriority, cust_bucket INTO NAME "column" VALUE level)
  GROUP BY "column", level) WHERE rank <= 5
""")
def q_top_categories(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority",
                                         (F.col("o_custkey") % 97).cast("string").alias("cust_bucket"))
    return profile.top_categories(o, k=5).select("column", "level", "count", "rank")


@register("profile_target_regression", f"""
SELECT 'o_totalprice' AS target, CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_unique,
  {r("avg(o_totalprice)", 4)} AS mean, {r("stddev_samp(o_totalprice)", 4)} AS std,
  {r("min(o_totalprice)", 4)} AS min, {r("max(o_totalprice)", 4)} AS max,
  {r("quantile_cont(o_totalprice, 0.5)", 4)} AS median, {r("skewness(o_totalprice)")} AS skewness,
  {r("sum((o_totalprice < lo OR o_totalprice > hi)::INT) / count(o_totalprice)")} AS outlier_rate,
  sum((o_totalprice < lo OR o_totalprice > hi)::INT) / count(o_totalprice) > 0.05 AS has_outliers
FROM orders, {_iqr_bounds_sql("o_totalprice", "orders")} b GROUP BY lo, hi
""")
def q_target_regression(spark, sf):
    return rounded(rounded(profile.target_profile_regression(table(spark, sf, "orders"), "o_totalprice"), 6)
                   .select("target", "n_unique", rcol("mean", 4).alias("mean"),
                           rcol("std", 4).alias("std"), rcol("min", 4).alias("min"),
                           rcol("max", 4).alias("max"), rcol("median", 4).alias("median"),
                           "skewness", "outlier_rate", "has_outliers"))


@register("profile_target_classes", f"""
SELECT 'quality' AS target, CAST(count(*) AS BIGINT) AS n_classes, CAST(max(k) AS BIGINT) AS max_count,
  CAST(min(k) AS BIGINT) AS minority_class_size, {r("max(k) / min(k)")} AS class_balance_ratio,
  max(k) / min(k) > 2 AS is_imbalanced,
  CASE WHEN max(k) / min(k) > 10 THEN 'severe' WHEN max(k) / min(k) > 5 THEN 'moderate'
       WHEN max(k) / min(k) > 2 THEN 'mild' ELSE 'none' END AS imbalance_severity
FROM (SELECT quality, count(*) AS k FROM labels WHERE quality IS NOT NULL GROUP BY quality)
""")
def q_target_classes(spark, sf):
    return rounded(profile.target_profile_classes(table(spark, sf, "labels"), "quality"))


@register("profile_task_type", f"""
SELECT 'quality' AS target, CAST(count(DISTINCT quality) AS BIGINT) AS n_unique,
  {r("count(DISTINCT quality) / count(*)")} AS unique_ratio,
  CASE WHEN (count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1)
         OR count(DISTINCT quality) <= 10 OR count(DISTINCT quality) / count(*) < 0.02
       THEN 'classification' ELSE 'regression' END AS detected,
  CASE WHEN count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1 THEN 'high'
       WHEN count(DISTINCT quality) <= 10 THEN CASE WHEN count(DISTINCT quality) <= 5 THEN 'med' ELSE 'low' END
       ELSE 'med' END AS confidence
FROM labels
""")
def q_task_type(spark, sf):
    return rounded(profile.detect_task_type(table(spark, sf, "labels"), "quality"))


@register("profile_task_type_float", f"""
SELECT 'o_totalprice' AS target, CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_unique,
  {r("count(DISTINCT o_totalprice) / count(*)")} AS unique_ratio,
  CASE WHEN count(DISTINCT o_totalprice) <= 10 OR count(DISTINCT o_totalprice) / count(*) < 0.02
       THEN 'classification' ELSE 'regression' END AS detected,
  CASE WHEN count(DISTINCT o_totalprice) <= 10 THEN 'med'
       WHEN count(DISTINCT o_totalprice) / count(*) < 0.02 THEN 'low' ELSE 'high' END AS confidence
FROM orders
""")
def q_task_type_float(spark, sf):
    return rounded(profile.detect_task_type(table(spark, sf, "orders"), "o_totalprice"))


def _labels_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf, "labels")
    return lab.join(d, "doc_id", "inner")


LD_SQL = "(SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"


@register("profile_dataset", f"""
WITH t AS {LD_SQL}, m AS (SELECT min(k) AS mino FROM (SELECT quality, count(*) AS k FROM t GROUP BY quality))
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_features, {r("4 / count(*)")} AS p_n_ratio,
  {r("0.0")} AS total_missing_rate, CAST(0 AS BIGINT) AS n_features_missing,
  CAST(0 AS BIGINT) AS n_features_high_missing, CAST(0 AS BIGINT) AS n_features_critical_missing,
  'classification' AS task_type, CAST(any_value(mino) AS BIGINT) AS minority_class_size,
  {r("any_value(mino) / 4")} AS events_per_variable,
  CASE least(CASE WHEN count(*) < 50 THEN 0 WHEN count(*) < 100 THEN 1 WHEN count(*) < 500 THEN 2
                  WHEN count(*) < 5000 THEN 3 ELSE 4 END,
             CASE WHEN 4 / count(*) > 1 THEN 0 WHEN 4 / count(*) > 0.5 THEN 1 ELSE 4 END,
             CASE WHEN any_value(mino) / 4 < 5 THEN 0 WHEN any_value(mino) / 4 < 10 THEN 1 ELSE 4 END)
    WHEN 0 THEN 'critical' WHEN 1 THEN 'scarce' WHEN 2 THEN 'limited' WHEN 3 THEN 'adequate'
    ELSE 'abundant' END AS sufficiency
FROM t, m
""")
def q_dataset(spark, sf):
    t = _labels_docs(spark, sf).select("doc_id", "quality", "toxic", "n_chars", "lang", "source")
    return rounded(profile.dataset_profile(t, target="quality",
                                           features=["toxic", "n_chars", "lang", "source"]))


@register("profile_entity_summary", f"""
SELECT 'user_id' AS entity, CAST(count(*) AS BIGINT) AS entities, {r("quantile_cont(k, 0.5)")} AS median_rows,
  {r("avg(k)")} AS mean_rows, {r("avg((k > 1)::INT)")} AS repeat_share,
  CASE WHEN quantile_cont(k, 0.5) > 1 OR avg((k > 1)::INT) > 0.2 THEN 'longitudinal' ELSE 'cross_sectional' END AS design
FROM (SELECT user_id, count(*) AS k FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
""")
def q_entity_summary(spark, sf):
    return rounded(profile.entity_summary(table(spark, sf, "events"), "user_id"))


def _hist_sql(src, x, bins):
    return f"""WITH s AS (SELECT min({x}) AS mn, max({x}) AS mx FROM {src}),
h AS (SELECT least(CAST(floor(({x} - mn) / ((mx - mn) / {bins})) AS INTEGER), {bins - 1}) AS bin, mn, mx
      FROM {src}, s WHERE {x} IS NOT NULL)
SELECT bin, {r(f"mn + bin * ((mx - mn) / {bins})")} AS lo, {r(f"mn + (bin + 1) * ((mx - mn) / {bins})")} AS hi,
       count(*) AS count FROM h GROUP BY bin, mn, mx"""


@register("profile_rows_per_entity",
          _hist_sql("(SELECT user_id, CAST(count(*) AS DOUBLE) AS rows FROM events GROUP BY user_id)", "rows", 20))
def q_rows_per_entity(spark, sf):
    return rounded(profile.rows_per_entity(table(spark, sf, "events"), "user_id", 20))


@register("profile_histogram", _hist_sql("orders", "o_totalprice", 30))
def q_histogram(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "orders"), "o_totalprice", 30))


@register("profile_cohort_structure", f"""
SELECT 'event_id' AS "column", 'entity' AS role, {r("count(DISTINCT event_id) / count(*)")} AS unique_ratio FROM events
UNION ALL SELECT 'user_id', 'entity', {r("count(DISTINCT user_id) / count(*)")} FROM events
UNION ALL SELECT 'ts', 'time', {r("count(DISTINCT ts) / count(*)")} FROM events
""")
def q_cohort_structure(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rounded(profile.cohort_structure(ev))


@register("profile_column_signals", union_sql([
    f"""SELECT '{c}' AS "column", {cls} AS column_class, {r(f"sum(({c} IS NULL)::INT) / count(*)")} AS missing_rate,
  sum(({c} IS NULL)::INT) / count(*) > 0.05 AS high_missing,
  ({cls}) = 'categorical' AND count(DISTINCT {c}) > count(*) * 0.5 AS high_cardinality
FROM (SELECT doc_id, nullif(lang, 'en') AS lang, source, text, n_chars FROM documents)"""
    for c, cls in [("doc_id", "'numeric'"), ("lang", f"CASE WHEN count(DISTINCT lang) / count(*) > 0.8 THEN 'text_like' ELSE 'categorical' END"),
                   ("source", f"CASE WHEN count(DISTINCT source) / count(*) > 0.8 THEN 'text_like' ELSE 'categorical' END"),
                   ("text", f"CASE WHEN count(DISTINCT text) / count(*) > 0.8 THEN 'text_like' ELSE 'categorical' END"),
                   ("n_chars", "'numeric'")]]))
def q_column_signals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("nullif(lang, 'en')").alias("lang"),
                                            "source", "text", "n_chars")
    return rounded(profile.column_signals(d))


@register("profile_target_signals", f"""
SELECT CAST(count(DISTINCT value) AS BIGINT) AS n_unique, CAST(sum((value IS NULL)::INT) AS BIGINT) AS n_missing,
  {r("sum((value IS NULL)::INT) / count(*)")} AS missing_rate, {r("avg(value)")} AS mean,
  {r("quantile_cont(value, 0.5)")} AS median, {r("stddev_samp(value)")} AS std,
  {r("skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1))")} AS skew,
  {r("kurtosis_pop(value)")} AS kurtosis,
  {r("sum((value < lo OR value > hi)::INT) / count(value)")} AS outlier_rate
FROM events, {_iqr_bounds_sql("value", "events")} b GROUP BY lo, hi
""")
def q_target_signals(spark, sf):
    return rounded(profile.target_signals(table(spark, sf, "events"), "value", "regression"))


@register("profile_box_by_group", f"""
SELECT event_type AS "group", count(value) AS n, {r("min(value)")} AS min, {r("quantile_cont(value, 0.25)")} AS q1,
  {r("quantile_cont(value, 0.5)")} AS median, {r("quantile_cont(value, 0.75)")} AS q3, {r("max(value)")} AS max,
  {r("avg(value)")} AS mean
FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type
""")
def q_box_by_group(spark, sf):
    return rounded(profile.box_by_group(table(spark, sf, "events"), "value", group="event_type"))


@register("profile_box_tertiles", f"""
WITH b AS (SELECT quantile_cont(c_acctbal, 1/3) AS t1, quantile_cont(c_acctbal, 2/3) AS t2 FROM customer),
g AS (SELECT CASE WHEN c_acctbal <= t1 THEN 'Low' WHEN c_acctbal <= t2 THEN 'Mid' ELSE 'High' END AS grp,
             CAST(c_nationkey AS DOUBLE) AS v FROM customer, b)
SELECT grp AS "group", count(v) AS n, {r("min(v)")} AS min, {r("quantile_cont(v, 0.25)")} AS q1,
  {r("quantile_cont(v, 0.5)")} AS median, {r("quantile_cont(v, 0.75)")} AS q3, {r("max(v)")} AS max,
  {r("avg(v)")} AS mean FROM g GROUP BY grp
""")
def q_box_tertiles(spark, sf):
    return rounded(profile.box_by_group(table(spark, sf, "customer"), "c_nationkey", tertile_of="c_acctbal"))


@register("profile_class_balance", f"""
SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count, {r("count(*) / sum(count(*)) OVER ()")} AS share,
  {r("max(count(*)) OVER () / sum(count(*)) OVER ()")} AS majority_baseline,
  min(count(*)) OVER () / max(count(*)) OVER () < 0.5 AS imbalance_warning
FROM labels WHERE toxic IS NOT NULL GROUP BY toxic
""")
def q_class_balance(spark, sf):
    return rounded(profile.class_balance(table(spark, sf, "labels"), "toxic"))


@register("profile_scaling_check", union_sql([
    f"""SELECT '{c}' AS "column", {r(f"min({c})")} AS min, {r(f"max({c})")} AS max, {r(f"stddev_samp({c})")} AS std,
  {r(f"max({c}) - min({c})")} AS range FROM part""" for c in ["p_partkey", "p_size", "p_retailprice"]]))
def q_scaling(spark, sf):
    return rounded(profile.scaling_check(table(spark, sf, "part")))


@register("profile_np_sufficiency", f"""
SELECT count(*) AS n, CAST(3 AS BIGINT) AS p, {r("count(*) / 3")} AS n_per_p, count(*) / 3 < 20 AS warn FROM supplier
""")
def q_np(spark, sf):
    return rounded(profile.np_sufficiency(table(spark, sf, "supplier"), ["s_nationkey", "s_acctbal", "s_name"]))


@register("profile_exclusion_flow", """
SELECT CASE WHEN o_totalprice < 1000 THEN 'excluded:low_price'
            WHEN o_orderstatus = 'P' THEN 'excluded:pending'
            WHEN CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END IS NULL THEN 'missing_target'
            ELSE 'analysed:' || o_orderpriority END AS stage, count(*) AS count
FROM orders GROUP BY 1
""")
def q_exclusion_flow(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "target", F.expr("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END"))
    return profile.exclusion_flow(o, [("low_price", F.col("o_totalprice") < 1000),
                                      ("pending", F.col("o_orderstatus") == "P")],
                                  target="target", split_col="o_orderpriority")


# ------------------------------------------------------------------ outliers

def _out_sql(method, c, src):
    if method == "iqr":
        b = _iqr_bounds_sql(c, src)
        cond = f"(nb >= 3 AND iqr <> 0 AND ({c} < lo OR {c} > hi))"
        lo, hi = "CASE WHEN nb >= 3 AND iqr <> 0 THEN lo END", "CASE WHEN nb >= 3 AND iqr <> 0 THEN hi END"
        grp = "lo, hi, iqr, nb"
    elif method == "percentile":
        b = f"(SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi, count({c}) AS nb FROM {src})"
        cond = f"(nb >= 3 AND ({c} < lo OR {c} > hi))"
        lo, hi, grp = "lo", "hi", "lo, hi, nb"
    elif method == "zscore":
        b = f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS nb FROM {src})"
        cond = f"(nb >= 3 AND s <> 0 AND abs(({c} - m) / s) > 3.0)"
        lo, hi, grp = "m - 3.0 * s", "m + 3.0 * s", "m, s, nb"
    else:
        b = (f"(SELECT med, quantile_cont(abs({c} - med), 0.5) AS mad, count({c}) AS nb FROM {src}, "
             f"(SELECT quantile_cont({c}, 0.5) AS med FROM {src}) GROUP BY med)")
        cond = f"(nb >= 3 AND mad <> 0 AND abs(0.6745 * ({c} - med) / mad) > 3.5)"
        lo, hi, grp = "med - 3.5 * 1.4826 * mad", "med + 3.5 * 1.4826 * mad", "med, mad, nb"
    return f"""SELECT '{c}' AS "column", '{method}' AS method, CAST(any_value(nb) AS BIGINT) AS n,
  {r(lo)} AS lower, {r(hi)} AS upper, CAST(sum(({cond})::INT) AS BIGINT) AS outlier_count,
  {r(f"sum(({cond})::INT) / any_value(nb)")} AS outlier_rate
FROM {src}, {b} bb GROUP BY {grp}"""


for _m in ("iqr", "mad", "zscore", "percentile"):
    def _mk(m):
        @register(f"outliers_{m}", union_sql([_out_sql(m, c, "lineitem")
                                              for c in ["l_quantity", "l_extendedprice", "l_discount"]]))
        def _q(spark, sf):
            return rounded(outliers.outlier_summary(table(spark, sf, "lineitem"),
                                                    ["l_quantity", "l_extendedprice", "l_discount"], m))
        return _q
    _mk(_m)


@register("outliers_influence", _out_sql("iqr", "l_extendedprice", "lineitem"))
def q_outlier_influence(spark, sf):
    return rounded(outliers.outlier_influence(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("outliers_flag_rows", f"""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) - 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo,
                  quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi FROM orders)
SELECT o_orderkey, {r("o_totalprice")} AS o_totalprice, coalesce(o_totalprice < lo OR o_totalprice > hi, false) AS o_totalprice_outlier
FROM orders, b
""")
def q_flag_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(outliers.flag_outliers(o, ["o_totalprice"], "iqr"))


# -------------------------------------------------------------- plausibility

def _clin(spark, sf):
    """Clinical-named columns derived from lineitem/part values."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_quantity") * 4.0).alias("weight_lb"),
                     (F.col("l_quantity") * 3.0 + 20).alias("glucose_mg"),
                     (F.col("l_discount") * 60.0).alias("bmi"),
                     (F.col("l_tax") * 100.0 + 150).alias("height"))


CLIN_SQL = ("(SELECT l_quantity * 4.0 AS weight_lb, l_quantity * 3.0 + 20 AS glucose_mg, "
            "l_discount * 60.0 AS bmi, l_tax * 100.0 + 150 AS height FROM lineitem)")


def _unit_sql():
    hyps = {"weight_lb": ("weight", "kg", [("kg", 1.0, 30, 200), ("lb", 0.453592, 66, 440)]),
            "glucose_mg": ("glucose", "mg/dL", [("mg/dL", 1.0, 70, 125), ("mmol/L", 18.0, 3.9, 6.9)]),
            "bmi": ("bmi", "kg/m²", [("kg/m²", 1.0, 15, 50)]),
            "height": ("height", "cm", [("cm", 1.0, 100, 220), ("inches", 2.54, 39, 87),
                                        ("meters", 100.0, 1.0, 2.2)])}
    parts = []
    for c, (v, cu, hs) in hyps.items():
        for o, (u, f, lo, hi) in enumerate(hs):
            w = hi - lo
            parts.append(f"""SELECT '{c}' AS "column", '{v}' AS variable, '{cu}' AS canonical_unit, {o} AS h_order,
  '{u}' AS inferred_unit, CAST({f} AS DOUBLE) AS factor,
  sum(({c} >= {lo} AND {c} <= {hi})::INT) / count({c}) AS fit_share,
  sum(({c} >= {lo} AND {c} <= {hi})::INT) / count({c}) - sum(({c} < {lo} - 2 * {w} OR {c} > {hi} + 2 * {w})::INT) / count({c}) * 0.5 AS score
FROM {CLIN_SQL}""")
    return f"""SELECT "column", variable, canonical_unit, inferred_unit, factor, {r("fit_share")} AS fit_share,
  {r("score")} AS score,
  CASE WHEN fit_share >= 0.9 THEN 'high' WHEN fit_share >= 0.7 THEN 'med' ELSE 'low' END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY score DESC, h_order) AS rk FROM ({union_sql(parts)}))
WHERE rk = 1"""


@register("plausibility_infer_units", _unit_sql())
def q_infer_units(spark, sf):
    return rounded(plausibility.infer_units(_clin(spark, sf), ["weight_lb", "glucose_mg", "bmi", "height"]))


BOUNDS = {"l_quantity": (2.0, 48.0), "l_discount": (0.01, 0.09)}


@register("plausibility_gate", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 2.0 AND 48.0 THEN l_quantity END AS l_quantity,
       CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN l_discount END AS l_discount, {r("l_tax")} AS l_tax
FROM lineitem
""")
def q_gate(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(plausibility.plausibility_gate(li, BOUNDS))


@register("plausibility_filter", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity BETWEEN 2.0 AND 48.0 AND l_discount BETWEEN 0.01 AND 0.09
""")
def q_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return plausibility.plausibility_filter(li, BOUNDS)


@register("plausibility_report", union_sql([
    f"""SELECT '{c}' AS "column", {r(lo)} AS lower, {r(hi)} AS upper, count({c}) AS n, {r(f"min({c})")} AS min_canonical,
  {r(f"max({c})")} AS max_canonical, CAST(sum(({c} < {lo} OR {c} > {hi})::INT) AS BIGINT) AS n_out,
  {r(f"sum(({c} < {lo} OR {c} > {hi})::INT) / count({c})")} AS out_share,
  sum(({c} < {lo} OR {c} > {hi})::INT) / count({c}) > 0.05 AS flagged FROM lineitem"""
    for c, (lo, hi) in BOUNDS.items()]))
def q_report(spark, sf):
    return rounded(plausibility.plausibility_report(table(spark, sf, "lineitem"), BOUNDS))


@register("plausibility_guideline_bands", f"""
WITH t AS (SELECT l_quantity * 3.0 + 20 AS glucose_mg FROM lineitem),
b AS (SELECT count(glucose_mg) AS n,
  sum((glucose_mg >= 70 AND glucose_mg < 99)::INT) AS b0, sum((glucose_mg >= 100 AND glucose_mg < 125)::INT) AS b1,
  sum((glucose_mg >= 126)::INT) AS b2,
  sum((glucose_mg IS NOT NULL AND NOT ((glucose_mg >= 70 AND glucose_mg < 99) OR (glucose_mg >= 100 AND glucose_mg < 125) OR glucose_mg >= 126))::INT) AS b3 FROM t)
SELECT 'glucose_mg' AS "column", band, band_order, CAST(k AS BIGINT) AS count, {r("k / n")} AS share FROM b,
(VALUES ('normal', 0), ('prediabetes', 1), ('diabetes', 2), ('unbanded', 3)) v(band, band_order),
LATERAL (SELECT CASE band_order WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END AS k)
""")
def q_bands(spark, sf):
    return rounded(plausibility.guideline_bands(_clin(spark, sf), "glucose_mg", "glucose", "mg/dL"))


@register("plausibility_harmonize", f"""
SELECT {r("weight_lb * 0.453592")} AS weight_lb, {r("glucose_mg")} AS glucose_mg, {r("bmi")} AS bmi, {r("height")} AS height
FROM {CLIN_SQL}
""")
def q_harmonize(spark, sf):
    return rounded(plausibility.harmonize_units(_clin(spark, sf), {"weight_lb": 0.453592}))


@register("profile_data_warnings")
def q_warnings(spark, sf):
    t = _labels_docs(spark, sf).select("doc_id", "quality", "toxic", "n_chars", "lang", "source")
    feats = ["toxic", "n_chars", "lang", "source"]
    prof = profile.dataset_profile(t, target="quality", features=feats)
    return profile.data_warnings(prof, profile.feature_profile(t, feats), profile.target_profile_classes(t, "quality"))
