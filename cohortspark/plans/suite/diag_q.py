"""Association and regression-diagnostic computations (ops 94-104)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import diagnostics as dg
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table, union_sql


def _li(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (F.col("l_extendedprice") * 0.001 + F.col("l_quantity") * 0.01).alias("price_k"),
                     F.expr("nullif(l_tax, 0.0)").alias("tax_nn"), "l_returnflag")


_LI = ("(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * 0.001 + l_quantity * 0.01 AS price_k, "
       "nullif(l_tax, 0.0) AS tax_nn, l_returnflag FROM lineitem)")
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "price_k", "tax_nn"]


@register("diag_correlation_matrix", union_sql([
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f"corr({a}, {b})")} AS r, {r(f"abs(corr({a}, {b}))")} AS abs_r FROM {_LI}"""
    for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]))
def q_corr(spark, sf):
    return rounded(dg.correlation_matrix(_li(spark, sf), _COLS))


@register("diag_collinear_pairs", f"""
SELECT * FROM ({union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS r, {r(f'abs(corr({a}, {b}))')} AS abs_r FROM {_LI}"
    for i, a in enumerate(_COLS) for b in _COLS[i + 1:]])}) WHERE abs_r > 0.85
""")
def q_collinear(spark, sf):
    return rounded(dg.collinear_pairs(dg.correlation_matrix(_li(spark, sf), _COLS)))


@register("diag_leakage_scan", union_sql([
    f"""SELECT '{c}' AS "column", {r(f"corr({c}, l_extendedprice)")} AS r, {r(f"abs(corr({c}, l_extendedprice))")} AS abs_r,
  abs(corr({c}, l_extendedprice)) > 0.95 AS leak_suspect FROM {_LI}""" for c in ["l_quantity", "l_discount", "price_k", "tax_nn"]]))
def q_leakage(spark, sf):
    return rounded(dg.leakage_scan(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "price_k", "tax_nn"]))


@register("diag_top_associations", f"""
SELECT col AS "column", r, abs_r, rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs_r DESC, col) AS rank FROM ({union_sql([
    f"SELECT '{c}' AS col, {r(f'corr({c}, l_extendedprice)')} AS r, {r(f'abs(corr({c}, l_extendedprice))')} AS abs_r FROM {_LI}"
    for c in ["l_quantity", "l_discount", "price_k", "tax_nn"]])})) WHERE rank <= 3
""")
def q_top_assoc(spark, sf):
    return rounded(dg.top_associations(_li(spark, sf), "l_extendedprice",
                                       ["l_quantity", "l_discount", "price_k", "tax_nn"], 3))


def _mi_sql(c, src, y, bins=10):
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    return f"""SELECT '{c}' AS feature, {r("sum(n / NN * ln(n * NN / (nb * ny)))")} AS mi FROM (
  SELECT n, sum(n) OVER () AS NN, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM (
    SELECT b, y, count(*) AS n FROM (
      SELECT len(list_filter(e, lambda v: v < CAST({c} AS DOUBLE))) AS b, CAST({y} AS VARCHAR) AS y
      FROM {src}, (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{probs}])) AS e FROM {src})
      WHERE {c} IS NOT NULL AND {y} IS NOT NULL) GROUP BY b, y))"""


_LD = "(SELECT l.quality, d.n_chars, l.doc_id FROM labels l JOIN documents d USING (doc_id))"


@register("diag_mutual_information", union_sql([_mi_sql("n_chars", _LD, "quality"), _mi_sql("doc_id", _LD, "quality")]))
def q_mi(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    t = lab.join(d, "doc_id").select("quality", "n_chars", "doc_id")
    return rounded(dg.mutual_information(t, "quality", ["n_chars", "doc_id"]))


@register("diag_dose_response", f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM orders),
b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda v: v < o_totalprice)) AS bin, o_custkey, e FROM orders, e WHERE o_totalprice IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, {r("e[bin + 1]")} AS lo, {r("e[bin + 2]")} AS hi, {r("(e[bin + 1] + e[bin + 2]) / 2")} AS mid,
  count(*) AS n, {r("avg(o_custkey)")} AS mean_target FROM b GROUP BY bin, e
""")
def q_dose(spark, sf):
    return rounded(dg.dose_response(table(spark, sf, "orders"), "o_totalprice", "o_custkey"))


@register("diag_linearity")
def q_linearity(spark, sf):
    return dg.linearity_tests(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "price_k", "tax_nn"], 3)


@register("diag_ols_residuals_single", f"""
WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM lineitem),
t AS (SELECT coalesce(l_quantity, med) AS x, l_extendedprice AS y FROM lineitem, m WHERE l_extendedprice IS NOT NULL),
f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM t)
SELECT {r("y", 4)} AS y, {r("a + b * x", 4)} AS fitted, {r("y - (a + b * x)", 4)} AS residual FROM t, f
""")
def q_ols_single(spark, sf):
    res = dg.ols_residuals(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(res, 4)


@register("diag_ols_residuals")
def q_ols_multi(spark, sf):
    return dg.ols_residuals(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "tax_nn"])


@register("diag_influence_single", f"""
WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, avg(x) AS mx, var_pop(x) * count(*) AS sxx, count(*) AS n FROM t),
h AS (SELECT 1.0 / n + (x - mx) ^ 2 / sxx AS h, y - (a + b * x) AS e FROM t, f),
m AS (SELECT avg(e * e) + 1e-12 AS mse, count(*) AS n FROM h)
SELECT CAST(any_value(n) AS BIGINT) AS n, {r("max(h)")} AS max_leverage, {r("max(e * e / (2 * mse) * h / (1 - h) ^ 2)")} AS max_cooks,
  CAST(sum((h > 2.0 * 2 / n)::INT) AS BIGINT) AS n_high_leverage,
  CAST(sum((e * e / (2 * mse) * h / (1 - h) ^ 2 > 1)::INT) AS BIGINT) AS n_high_cooks
FROM h, m
""")
def q_influence_single(spark, sf):
    return rounded(dg.influence_summary(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]))


@register("diag_influence")
def q_influence_multi(spark, sf):
    return dg.influence_summary(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "tax_nn"])


@register("diag_residual_qq")
def q_qq(spark, sf):
    return dg.residual_qq(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"])


@register("diag_vif_two", f"""
SELECT feature, {r("1 / (1 - rr * rr)")} AS vif, 1 / (1 - rr * rr) > 10 AS high FROM
(SELECT corr(l_quantity, l_discount) AS rr FROM lineitem), (VALUES ('l_quantity'), ('l_discount')) v(feature)
""")
def q_vif_two(spark, sf):
    return rounded(dg.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


@register("diag_vif")
def q_vif(spark, sf):
    return dg.vif(_li(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "price_k", "tax_nn"])
