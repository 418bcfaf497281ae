"""Feature-selection computations (ops 120-125)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.operators import featsel as fs
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table

FEATS = ["l_quantity", "l_discount", "l_tax", "price_k", "l_linenumber"]
KEY = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]


def _li(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
                     (F.col("l_extendedprice") * 0.001 + F.col("l_discount") * 40).alias("price_k"))


_LI = ("(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, "
       "l_extendedprice * 0.001 + l_discount * 40 AS price_k FROM lineitem)")


@register("featsel_lasso_path_cv")
def q_lasso(spark, sf):
    return fs.lasso_path_cv(_li(spark, sf), FEATS, "l_extendedprice", n_alphas=30, key=KEY)["coefficients"]


@register("featsel_lasso_path")
def q_lasso_path(spark, sf):
    return fs.lasso_path_cv(_li(spark, sf), FEATS, "l_extendedprice", n_alphas=30, key=KEY)["path"]


def _cls(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("text_len"),
                                            F.length("source").alias("src_len"))
    return lab.join(d, "doc_id")


@register("featsel_l1_logistic_cv")
def q_l1log(spark, sf):
    return fs.l1_logistic_cv(_cls(spark, sf), ["n_chars", "text_len", "src_len", "toxic"], "quality", n_cs=5,
                             folds=3, key=["doc_id"])


@register("featsel_rfe_cv")
def q_rfe(spark, sf):
    return fs.rfe_cv(_li(spark, sf), FEATS, "l_extendedprice", key=KEY)


@register("featsel_univariate_regression", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r(f"corr({c}, l_extendedprice)")} AS r, {r(f"abs(corr({c}, l_extendedprice))")} AS abs_r,
  count(*) AS n FROM {_LI}""" for c in FEATS))
def q_uni_reg(spark, sf):
    return rounded(fs.univariate_screen(_li(spark, sf), FEATS, "l_extendedprice").select("feature", "r", "abs_r", "n"))


@register("featsel_univariate_regression_p")
def q_uni_reg_p(spark, sf):
    return fs.univariate_screen(_li(spark, sf), FEATS, "l_extendedprice")


_CLS = ("(SELECT quality, n_chars, length(text) AS text_len, length(source) AS src_len "
        "FROM labels JOIN documents USING (doc_id))")


@register("featsel_univariate_classification", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r("corr(rx, ry)")} AS r, {r("abs(corr(rx, ry))")} AS abs_r, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry
  FROM {_CLS} WHERE {c} IS NOT NULL AND quality IS NOT NULL)""" for c in ["n_chars", "text_len", "src_len"]))
def q_uni_cls(spark, sf):
    return rounded(fs.univariate_screen(_cls(spark, sf), ["n_chars", "text_len", "src_len"], "quality",
                                        "classification").select("feature", "r", "abs_r", "n"))


@register("featsel_stability")
def q_stability(spark, sf):
    return fs.stability_selection(_li(spark, sf), FEATS, "l_extendedprice", n_bootstrap=30, alpha=50.0, key=KEY)


@register("featsel_consensus")
def q_consensus(spark, sf):
    d = _li(spark, sf)
    sels = [
        fs.lasso_path_cv(d, FEATS, "l_extendedprice", n_alphas=20, key=KEY)["coefficients"]
          .where("selected").select(F.lit("lasso").alias("method"), "feature"),
        fs.rfe_cv(d, FEATS, "l_extendedprice", key=KEY).where("selected").select(F.lit("rfe").alias("method"), "feature"),
        fs.univariate_screen(d, FEATS, "l_extendedprice").where("selected")
          .select(F.lit("univariate").alias("method"), "feature"),
    ]
    return fs.consensus(reduce(lambda a, b: a.unionByName(b), sels), 2)
