"""Evaluation, calibration and bootstrap computations (ops 147-167) on
predictions derived from the driver tables in SQL-expressible form."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import calibrate as cal
from cohortspark.operators import metrics as mt
from cohortspark.operators import resample as rs
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rcol, rounded, table


def reg_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * 1500.0 + 15000.0).alias("yhat"))


REG = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 + 15000.0 AS yhat FROM lineitem)"


def cls_preds(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    t = lab.join(d, "doc_id")
    p = F.round(1 / (1 + F.exp(-(F.log1p(F.col("n_chars").cast("double")) - 7.5))), 1)
    return t.select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"),
                    (p >= 0.5).cast("int").alias("yhat"))


CLS = ("(SELECT doc_id, lang, quality AS y, round(1 / (1 + exp(-(ln(1 + n_chars) - 7.5))), 1) AS p, "
       "CAST(round(1 / (1 + exp(-(ln(1 + n_chars) - 7.5))), 1) >= 0.5 AS INTEGER) AS yhat "
       "FROM labels JOIN documents USING (doc_id))")


@register("eval_regression_metrics", f"""
SELECT count(*) AS n, {r("avg(abs(y - yhat))")} AS mae, {r("sqrt(avg((y - yhat) ^ 2))")} AS rmse,
  {r("1 - avg((y - yhat) ^ 2) / var_pop(y)")} AS r2, {r("quantile_cont(abs(y - yhat), 0.5)")} AS median_ae FROM {REG}
""")
def q_reg(spark, sf):
    return rounded(mt.regression_metrics(reg_preds(spark, sf), "y", "yhat"))


@register("eval_per_class", f"""
WITH c AS {CLS}, lv AS (SELECT CAST(y AS VARCHAR) AS label FROM c UNION SELECT CAST(yhat AS VARCHAR) FROM c),
s AS (SELECT label, sum((CAST(y AS VARCHAR) = label)::INT) AS support, sum((CAST(yhat AS VARCHAR) = label)::INT) AS npred,
             sum((CAST(y AS VARCHAR) = label AND CAST(yhat AS VARCHAR) = label)::INT) AS tp FROM lv, c GROUP BY label)
SELECT label, CAST(support AS BIGINT) AS support, {r("CASE WHEN npred > 0 THEN tp / npred ELSE 0 END")} AS precision,
  {r("CASE WHEN support > 0 THEN tp / support ELSE 0 END")} AS recall,
  {r("CASE WHEN tp > 0 THEN 2 * (tp / npred) * (tp / support) / (tp / npred + tp / support) ELSE 0 END")} AS f1 FROM s
""")
def q_per_class(spark, sf):
    return rounded(mt.per_class(cls_preds(spark, sf), "y", "yhat"))


@register("eval_accuracy_f1", f"""
WITH c AS {CLS}, lv AS (SELECT CAST(y AS VARCHAR) AS label FROM c UNION SELECT CAST(yhat AS VARCHAR) FROM c),
s AS (SELECT label, sum((CAST(y AS VARCHAR) = label)::INT) AS support, sum((CAST(yhat AS VARCHAR) = label)::INT) AS npred,
             sum((CAST(y AS VARCHAR) = label AND CAST(yhat AS VARCHAR) = label)::INT) AS tp FROM lv, c GROUP BY label)
SELECT {r("sum(tp) / sum(support)")} AS accuracy,
  {r("sum(support * CASE WHEN tp > 0 THEN 2 * (tp / npred) * (tp / support) / (tp / npred + tp / support) ELSE 0 END) / sum(support)")} AS f1_weighted FROM s
""")
def q_acc(spark, sf):
    return rounded(mt.accuracy_f1(cls_preds(spark, sf), "y", "yhat"))


@register("eval_roc_auc", f"""
WITH c AS {CLS}, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rr FROM c)
SELECT {r("(sum(rr) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1))")} AS roc_auc FROM rk
""")
def q_auc(spark, sf):
    return rounded(mt.roc_auc(cls_preds(spark, sf), "y", "p"))


@register("eval_roc_auc_ovr", f"""
WITH e AS (SELECT label, CAST(vec_id % 7 AS DOUBLE) / 7 + CAST(label AS DOUBLE) / 20 AS s FROM embeddings),
k AS (SELECT DISTINCT label AS k FROM embeddings),
a AS (SELECT k, (sum(rr) FILTER (WHERE label = k) - count(*) FILTER (WHERE label = k) * (count(*) FILTER (WHERE label = k) + 1) / 2.0)
               / (count(*) FILTER (WHERE label = k) * count(*) FILTER (WHERE label <> k)) AS auc
      FROM (SELECT k, label, rank() OVER (PARTITION BY k ORDER BY CASE WHEN label = k THEN s ELSE 1 - s END) +
                   (count(*) OVER (PARTITION BY k, CASE WHEN label = k THEN s ELSE 1 - s END) - 1) / 2.0 AS rr FROM e, k) GROUP BY k)
SELECT {r("avg(auc)")} AS roc_auc_ovr FROM a
""")
def q_auc_ovr(spark, sf):
    e = table(spark, sf, "embeddings")
    labels = sorted(r[0] for r in e.select("label").distinct().collect())
    s = (F.col("vec_id") % 7).cast("double") / 7 + F.col("label").cast("double") / 20
    cols = {str(k): f"s{k}" for k in labels}
    t = e.select("label", *[F.when(F.col("label") == k, s).otherwise(1 - s).alias(f"s{k}") for k in labels])
    return rounded(mt.roc_auc_ovr(t, "label", cols))


@register("eval_average_precision", f"""
WITH c AS {CLS}, g AS (SELECT p, sum((y = 1)::INT) AS np, sum((y <> 1)::INT) AS nn FROM c GROUP BY p),
cum AS (SELECT p, np, sum(np) OVER (ORDER BY p DESC) AS tp, sum(nn) OVER (ORDER BY p DESC) AS fp FROM g)
SELECT {r("sum(CASE WHEN np > 0 THEN np * tp / (tp + fp) ELSE 0 END) / sum(np)")} AS average_precision FROM cum
""")
def q_ap(spark, sf):
    return rounded(mt.average_precision(cls_preds(spark, sf), "y", "p"))


@register("eval_log_loss", f"""
SELECT {r("avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END)")} AS log_loss FROM {CLS}
""")
def q_logloss(spark, sf):
    return rounded(mt.log_loss(cls_preds(spark, sf), "y", "p"))


@register("eval_classification_metrics")
def q_cls_all(spark, sf):
    return mt.classification_metrics(cls_preds(spark, sf), "y", "yhat", "p")


@register("eval_residual_stats", f"""
SELECT count(*) AS n, {r("avg(y - yhat)", 4)} AS mean_residual, {r("stddev_pop(y - yhat)", 4)} AS std_residual,
  {r("min(y - yhat)", 4)} AS min_residual, {r("max(y - yhat)", 4)} AS max_residual,
  {r("quantile_cont(y - yhat, 0.5)", 4)} AS median_residual,
  {r("skewness(y - yhat) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1))")} AS skew,
  {r("quantile_cont(y - yhat, 0.75) - quantile_cont(y - yhat, 0.25)", 4)} AS iqr, {r("quantile_cont(y - yhat, 0.05)", 4)} AS q5,
  {r("quantile_cont(y - yhat, 0.25)", 4)} AS q25, {r("quantile_cont(y - yhat, 0.75)", 4)} AS q75,
  {r("quantile_cont(y - yhat, 0.95)", 4)} AS q95, {r("corr(y - yhat, yhat)")} AS residual_vs_predicted_corr FROM {REG}
""")
def q_resid(spark, sf):
    res = mt.residual_stats(reg_preds(spark, sf), "y", "yhat")
    return rounded(rounded(res.select("n", "skew", "residual_vs_predicted_corr"), 6).join(
        rounded(res.drop("skew", "residual_vs_predicted_corr"), 4), "n"))


@register("eval_pred_vs_actual", f"""
SELECT {r("corr(y, yhat)")} AS correlation, {r("max(yhat - y)", 4)} AS max_overprediction,
  {r("min(yhat - y)", 4)} AS max_underprediction, {r("avg(yhat - y)", 4)} AS mean_error FROM {REG}
""")
def q_pva(spark, sf):
    t = mt.pred_vs_actual(reg_preds(spark, sf), "y", "yhat")
    return t.select(rcol("correlation", 6).alias("correlation"), rcol("max_overprediction", 4).alias("max_overprediction"),
                    rcol("max_underprediction", 4).alias("max_underprediction"), rcol("mean_error", 4).alias("mean_error"))


@register("eval_bias_by_quintile", f"""
WITH e AS (SELECT quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM {REG}),
q AS (SELECT i - 1 AS quintile, e[i] AS lo, CASE WHEN i = 5 THEN e[6] + 1e-9 ELSE e[i + 1] END AS hi FROM e, range(1, 6) t(i))
SELECT CAST(quintile AS INTEGER) AS quintile, {r("lo", 4)} AS lo, {r("hi", 4)} AS hi, count(y) AS n, {r("coalesce(avg(yhat - y), 0)", 4)} AS bias
FROM q LEFT JOIN {REG} ON y >= lo AND y < hi GROUP BY quintile, lo, hi
""")
def q_bias(spark, sf):
    return rounded(mt.bias_by_quintile(reg_preds(spark, sf), "y", "yhat"), 4)


@register("eval_confusion_matrix", """
SELECT CAST(label AS VARCHAR) AS actual, CAST(vec_id % 10 AS VARCHAR) AS predicted, count(*) AS count FROM embeddings GROUP BY 1, 2
""")
def q_confusion(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).alias("pred"))
    return mt.confusion_counts(e, "label", "pred")


@register("eval_top_confusions", """
SELECT CAST(label AS VARCHAR) AS actual, CAST(vec_id % 10 AS VARCHAR) AS predicted, count(*) AS count FROM embeddings
WHERE CAST(label AS VARCHAR) <> CAST(vec_id % 10 AS VARCHAR) GROUP BY 1, 2 ORDER BY count DESC, actual DESC, predicted DESC LIMIT 5
""")
def q_top_conf(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).alias("pred"))
    return mt.top_confusions(e, "label", "pred", 5)


@register("eval_bland_altman", f"""
WITH d AS (SELECT l_tax * 100 - l_discount * 100 AS d FROM lineitem),
s AS (SELECT avg(d) AS m, stddev_pop(d) AS s, count(*) AS n FROM d)
SELECT {r("m")} AS mean_diff, {r("s")} AS std_diff, {r("m - 1.96 * s")} AS loa_low, {r("m + 1.96 * s")} AS loa_high,
  {r("3.92 * s")} AS width_loa, n, CAST(sum((d < m - 1.96 * s OR d > m + 1.96 * s)::INT) AS BIGINT) AS n_outside_loa,
  {r("sum((d < m - 1.96 * s OR d > m + 1.96 * s)::INT) / n")} AS pct_outside_loa FROM d, s GROUP BY m, s, n
""")
def q_bland(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_tax") * 100).alias("a"), (F.col("l_discount") * 100).alias("b"))
    return rounded(mt.bland_altman(li, "a", "b"))


def _fold_scores(spark, sf):
    """Per (model, fold) MAE of three fixed predictors over hash folds of lineitem."""
    li = table(spark, sf, "lineitem")
    fold = (F.col("l_orderkey") % 5).cast("int")
    preds = {"qty_model": F.col("l_quantity") * 1500.0 + 15000.0, "mean_model": F.lit(53000.0),
             "disc_model": F.col("l_discount") * 100000.0 + 50000.0}
    out = None
    for m, p in preds.items():
        t = li.select(F.lit(m).alias("model"), fold.alias("fold"), F.abs(F.col("l_extendedprice") - p).alias("ae"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("model", "fold").agg(F.avg("ae").alias("score"))


@register("eval_fold_scores", f"""
SELECT model, CAST(fold AS INTEGER) AS fold, {r("avg(ae)", 4)} AS score FROM (
  SELECT 'qty_model' AS model, l_orderkey % 5 AS fold, abs(l_extendedprice - (l_quantity * 1500.0 + 15000.0)) AS ae FROM lineitem
  UNION ALL SELECT 'mean_model', l_orderkey % 5, abs(l_extendedprice - 53000.0) FROM lineitem
  UNION ALL SELECT 'disc_model', l_orderkey % 5, abs(l_extendedprice - (l_discount * 100000.0 + 50000.0)) FROM lineitem) GROUP BY 1, 2
""")
def q_fold_scores(spark, sf):
    return rounded(_fold_scores(spark, sf), 4)


@register("eval_paired_cv_comparison")
def q_paired_cv(spark, sf):
    return mt.paired_cv_comparison(_fold_scores(spark, sf))


def _importances(spark, sf):
    li = table(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    out = None
    for m, tgt in [("m_price", "l_extendedprice"), ("m_qty", "l_quantity")]:
        t = li.agg(*[F.abs(F.corr(f, tgt)).alias(f) for f in feats if f != tgt]).select(
            F.lit(m).alias("model"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"))
                                                         for f in feats if f != tgt])))
        out = t if out is None else out.unionByName(t)
    return out


@register("eval_importance_agreement")
def q_imp_agree(spark, sf):
    return mt.importance_rank_agreement(_importances(spark, sf), top_k=2)


@register("calib_brier", f"""SELECT {r("avg((p - y) ^ 2)")} AS brier FROM {CLS}""")
def q_brier(spark, sf):
    return rounded(cal.brier_score(cls_preds(spark, sf), "y", "p"))


_EDGES = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]"


@register("calib_reliability_bins", f"""
WITH c AS {CLS}, e AS (SELECT {_EDGES} AS e),
b AS (SELECT len(list_filter(e[2:10], lambda v: v <= p)) AS bin, y, p, e FROM c, e WHERE p >= 0 AND p <= 1)
SELECT CAST(bin AS INTEGER) AS bin, e[bin + 1] AS lo, e[bin + 2] AS hi, count(*) AS count, {r("avg(y)")} AS true_freq,
  {r("avg(p)")} AS pred_mean FROM b GROUP BY bin, e
""")
def q_bins(spark, sf):
    return rounded(cal.reliability_bins(cls_preds(spark, sf), "y", "p"))


@register("calib_classification", f"""
WITH c AS {CLS}, e AS (SELECT {_EDGES} AS e),
b AS (SELECT len(list_filter(e[2:10], lambda v: v <= p)) AS bin, y, p FROM c, e WHERE p >= 0 AND p <= 1),
g AS (SELECT bin, count(*) AS k, avg(y) AS f, avg(p) AS m FROM b GROUP BY bin)
SELECT {r("(SELECT avg((p - y) ^ 2) FROM c)")} AS brier, {r("sum(k * abs(f - m)) / sum(k)")} AS ece, {r("max(abs(f - m))")} AS mce FROM g
""")
def q_calib_cls(spark, sf):
    return rounded(cal.calibration_classification(cls_preds(spark, sf), "y", "p"))


@register("calib_regression", f"""
SELECT {r("regr_slope(y, yhat)")} AS calibration_slope, {r("regr_intercept(y, yhat)", 4)} AS calibration_intercept,
  {r("regr_r2(y, yhat)")} AS calibration_r2 FROM {REG}
""")
def q_calib_reg(spark, sf):
    t = cal.calibration_regression(reg_preds(spark, sf), "y", "yhat")
    return t.select(rcol("calibration_slope", 6).alias("calibration_slope"),
                    rcol("calibration_intercept", 4).alias("calibration_intercept"),
                    rcol("calibration_r2", 6).alias("calibration_r2"))


@register("calib_platt")
def q_platt(spark, sf):
    return cal.platt_scaling(cls_preds(spark, sf), "y", "p").select("doc_id", "p", "p_platt")


@register("calib_isotonic")
def q_isotonic(spark, sf):
    return cal.isotonic_recalibration(cls_preds(spark, sf), "y", "p").select("doc_id", "p", "p_isotonic")


def _dca_sql():
    ths = [round(0.01 * i, 2) for i in range(1, 100)]
    vals = ", ".join(f"({t})" for t in ths)
    return f"""
WITH c AS {CLS}, t AS (SELECT CAST(th AS DOUBLE) AS th FROM (VALUES {vals}) v(th)),
s AS (SELECT count(*) AS n, sum(y) AS npos FROM c)
SELECT 'Treat All' AS model, th AS threshold, {r("npos / n - (1 - npos / n) * th / (1 - th)")} AS net_benefit FROM s, t
UNION ALL SELECT 'Treat None', th, 0.0 FROM t
UNION ALL SELECT 'model', th, {r("sum((p >= th AND y = 1)::INT) / any_value(n) - sum((p >= th AND y = 0)::INT) / any_value(n) * th / (1 - th)")}
FROM t, c, s GROUP BY th
"""


@register("calib_decision_curve", _dca_sql())
def q_dca(spark, sf):
    ths = [round(0.01 * i, 2) for i in range(1, 100)]
    return rounded(cal.decision_curve(cls_preds(spark, sf), "y", {"model": "p"}, ths))


@register("boot_regression")
def q_boot_reg(spark, sf):
    return rs.bootstrap_metrics(reg_preds(spark, sf), "y", "yhat", "regression", key=["l_orderkey", "l_linenumber", "y"])


@register("boot_classification")
def q_boot_cls(spark, sf):
    return rs.bootstrap_metrics(cls_preds(spark, sf), "y", "yhat", "classification", proba="p", key=["doc_id"])


@register("boot_subgroups")
def q_boot_sub(spark, sf):
    return rs.bootstrap_metrics(reg_preds(spark, sf), "y", "yhat", "regression", key=["l_orderkey", "l_linenumber", "y"],
                                by="l_returnflag")


@register("eval_comparison_table")
def q_comparison(spark, sf):
    """Baselines first, then models, with 'estimate [lo, hi]' text (op 158)."""
    from cohortspark.operators import models as md
    from cohortspark.operators import split as sp
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    d = sp.random_split(li, ["l_orderkey", "l_linenumber", "l_extendedprice"], 0.8, 0.0)
    tr, te = d.where("split = 'train'"), d.where("split <> 'train'")
    key = ["l_orderkey", "l_linenumber", "l_extendedprice"]

    def boot(m):
        return rs.bootstrap_metrics(m.transform(te), "l_extendedprice", "prediction", key=key) \
            .select(F.lit(m.name).alias("name"), "metric", "estimate", "ci_lower", "ci_upper")
    base = boot(md.fit_mean(tr, ["l_quantity"], "l_extendedprice"))
    mods = boot(md.fit_ols(tr, ["l_quantity", "l_discount"], "l_extendedprice", name="ols"))
    return mt.comparison_table(base, mods)
