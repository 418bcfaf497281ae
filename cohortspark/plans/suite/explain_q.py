"""Explanation and robustness computations (ops 168-174)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import explain as ex
from cohortspark.operators import models as md
from cohortspark.operators import sensitivity as sn
from cohortspark.operators import split as sp
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table
from cohortspark.plans.suite.eval_q import _fold_scores

FEATS = ["l_quantity", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_extendedprice"]


def _parts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FEATS, "l_extendedprice")
    d = sp.random_split(li, KEY, 0.8, 0.0)
    return d.where("split = 'train'"), d.where("split <> 'train'")


@register("explain_permutation_importance")
def q_perm(spark, sf):
    tr, te = _parts(spark, sf)
    m = md.fit_ols(tr, FEATS, "l_extendedprice")
    return ex.permutation_importance(m, te, "l_extendedprice", "regression", key=KEY, n_repeats=5)


@register("explain_partial_dependence")
def q_pdp(spark, sf):
    tr, te = _parts(spark, sf)
    m = md.fit_forest(tr, FEATS, "l_extendedprice", n_trees=10, max_depth=4)
    return ex.partial_dependence(m, te, ["l_quantity", "l_discount"])


@register("explain_linear_shap", f"""
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem)
SELECT 'l_quantity' AS feature, {r("avg(abs(b * (l_quantity - m)))", 4)} AS mean_abs_shap, CAST(1 AS INTEGER) AS rank FROM lineitem, s
""")
def q_linshap(spark, sf):
    li = table(spark, sf, "lineitem")
    m = md.fit_ols(li, ["l_quantity"], "l_extendedprice")
    out = ex.linear_shap(li, m.intercept, {"l_quantity": m.coef[0]})
    return rounded(out, 4)


@register("explain_sampled_shapley")
def q_shapley(spark, sf):
    tr, te = _parts(spark, sf)
    m = md.fit_forest(tr, FEATS, "l_extendedprice", n_trees=10, max_depth=4)
    vals = ex.sampled_shapley(m, te, KEY, n_permutations=4, background=tr)
    return ex.shap_importance(vals)


@register("sensitivity_seeds")
def q_seeds(spark, sf):
    tr, te = _parts(spark, sf)

    def train(seed):
        return md.fit_forest(tr, FEATS, "l_extendedprice", seed=seed, cells=True)

    def evaluate(m):
        return md.score_model(m, te, "l_extendedprice", "regression")
    res = sn.seed_sensitivity(train, evaluate)
    return sn.seed_stability(res, "rmse")


@register("sensitivity_feature_dropout")
def q_dropout(spark, sf):
    tr, te = _parts(spark, sf)
    return sn.feature_dropout_linear(tr, te, FEATS, "l_extendedprice")


@register("sensitivity_robustness_summary", f"""
WITH f AS (SELECT model, fold, avg(ae) AS score FROM (
  SELECT 'qty_model' AS model, l_orderkey % 5 AS fold, abs(l_extendedprice - (l_quantity * 1500.0 + 15000.0)) AS ae FROM lineitem
  UNION ALL SELECT 'mean_model', l_orderkey % 5, abs(l_extendedprice - 53000.0) FROM lineitem
  UNION ALL SELECT 'disc_model', l_orderkey % 5, abs(l_extendedprice - (l_discount * 100000.0 + 50000.0)) FROM lineitem) GROUP BY 1, 2),
b AS (SELECT model, score AS baseline FROM f WHERE fold = 0)
SELECT f.model, {r("any_value(baseline)", 4)} AS baseline, {r("avg(score)", 4)} AS mean, {r("stddev_pop(score)", 4)} AS sd,
  {r("min(score)", 4)} AS min, {r("max(score)", 4)} AS max, count(*) AS n_variations,
  {r("max(abs(score - baseline) / abs(baseline))")} AS max_rel_change, max(abs(score - baseline) / abs(baseline)) <= 0.1 AS robust
FROM f JOIN b USING (model) WHERE fold <> 0 GROUP BY f.model
""")
def q_robust(spark, sf):
    fsc = _fold_scores(spark, sf).withColumn("variation", F.when(F.col("fold") == 0, "Baseline").otherwise("fold"))
    out = sn.robustness_summary(fsc, "score", analysis="model")
    return rounded(rounded(out.select("model", "max_rel_change", "robust"), 6).join(
        rounded(out.drop("max_rel_change", "robust"), 4), "model"))
