"""Statistical-test computations (ops 71-91).

Statistics are SQL-checked; the p-values are attached by the same operators
and pinned by unit tests (DuckDB has no t/F/chi-square CDFs).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import htest
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def _rank_sql(x, src, part=""):
    p = f"PARTITION BY {part} " if part else ""
    sep = ", " if part else ""
    return (f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}{sep}{x}) - 1) / 2.0)")


@register("htest_pearson", f"""
SELECT 'pearson' AS method, count(*) AS n, {r("corr(l_extendedprice, l_quantity)")} AS r,
  {r("corr(l_extendedprice, l_quantity) ^ 2")} AS r_squared,
  CASE WHEN abs(corr(l_extendedprice, l_quantity)) < 0.1 THEN 'negligible' WHEN abs(corr(l_extendedprice, l_quantity)) < 0.3 THEN 'weak'
       WHEN abs(corr(l_extendedprice, l_quantity)) < 0.5 THEN 'moderate' WHEN abs(corr(l_extendedprice, l_quantity)) < 0.7 THEN 'strong'
       ELSE 'very strong' END AS strength
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL
""")
def q_pearson(spark, sf):
    return rounded(htest.correlation_test(_li(spark, sf), "l_extendedprice", "l_quantity", "pearson")
                   .drop("p_value"))


@register("htest_pearson_p")
def q_pearson_p(spark, sf):
    return htest.correlation_test(_li(spark, sf), "l_extendedprice", "l_quantity", "pearson")


@register("htest_spearman", f"""
WITH t AS (SELECT l_extendedprice AS x, l_discount AS y FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
rk AS (SELECT {_rank_sql("x", "t")} AS rx, {_rank_sql("y", "t")} AS ry FROM t)
SELECT 'spearman' AS method, count(*) AS n, {r("corr(rx, ry)")} AS r, {r("corr(rx, ry) ^ 2")} AS r_squared,
  CASE WHEN abs(corr(rx, ry)) < 0.1 THEN 'negligible' WHEN abs(corr(rx, ry)) < 0.3 THEN 'weak'
       WHEN abs(corr(rx, ry)) < 0.5 THEN 'moderate' WHEN abs(corr(rx, ry)) < 0.7 THEN 'strong' ELSE 'very strong' END AS strength
FROM rk
""")
def q_spearman(spark, sf):
    return rounded(htest.correlation_test(_li(spark, sf), "l_extendedprice", "l_discount", "spearman")
                   .drop("p_value"))


@register("htest_spearman_p")
def q_spearman_p(spark, sf):
    return htest.correlation_test(_li(spark, sf), "l_extendedprice", "l_discount", "spearman")


@register("htest_kendall", f"""
WITH t AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
c AS (SELECT count(*) AS n FROM t),
pr AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN 1 ELSE 0 END) AS conc,
              sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN 1 ELSE 0 END) AS disc,
              sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN 1 ELSE 0 END) AS tx,
              sum(CASE WHEN a.y = b.y AND a.x <> b.x THEN 1 ELSE 0 END) AS ty
       FROM (SELECT x, y, row_number() OVER () AS i FROM t) a JOIN (SELECT x, y, row_number() OVER () AS i FROM t) b ON a.i < b.i)
SELECT 'kendall' AS method, n, {r("(conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))")} AS r,
  {r("((conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))) ^ 2")} AS r_squared,
  CASE WHEN abs((conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))) < 0.1 THEN 'negligible'
       WHEN abs((conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))) < 0.3 THEN 'weak'
       WHEN abs((conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))) < 0.5 THEN 'moderate'
       WHEN abs((conc - disc) / sqrt((conc + disc + tx) * (conc + disc + ty))) < 0.7 THEN 'strong' ELSE 'very strong' END AS strength
FROM c, pr
""")
def q_kendall(spark, sf):
    return rounded(htest.correlation_test(table(spark, sf, "part"), "p_size", "p_retailprice", "kendall")
                   .drop("p_value"))


def _two_sql(stat):
    return f"""WITH t AS (SELECT l_extendedprice AS v, l_linestatus = 'F' AS first FROM lineitem
                WHERE l_linestatus IN ('F', 'O') AND l_extendedprice IS NOT NULL)
{stat}"""


@register("htest_ttest", _two_sql(f"""
SELECT 't-test (ind.)' AS test, count(v) FILTER (WHERE first) AS n1, count(v) FILTER (WHERE NOT first) AS n2,
  {r("(avg(v) FILTER (WHERE first) - avg(v) FILTER (WHERE NOT first)) / sqrt(((count(v) FILTER (WHERE first) - 1) * var_samp(v) FILTER (WHERE first) + (count(v) FILTER (WHERE NOT first) - 1) * var_samp(v) FILTER (WHERE NOT first)) / (count(v) - 2) * (1.0 / count(v) FILTER (WHERE first) + 1.0 / count(v) FILTER (WHERE NOT first)))")} AS statistic
FROM t"""))
def q_ttest(spark, sf):
    return rounded(htest.two_sample_test(_li(spark, sf), "l_extendedprice", "l_linestatus", "F", "O", True)
                   .drop("p_value"))


@register("htest_ttest_p")
def q_ttest_p(spark, sf):
    return htest.two_sample_test(_li(spark, sf), "l_extendedprice", "l_linestatus", "F", "O", True)


@register("htest_mannwhitney", _two_sql(f"""
, rk AS (SELECT first, {_rank_sql("v", "t")} AS rr FROM t)
SELECT 'Mann-Whitney U' AS test, count(*) FILTER (WHERE first) AS n1, count(*) FILTER (WHERE NOT first) AS n2,
  {r("sum(rr) FILTER (WHERE first) - count(*) FILTER (WHERE first) * (count(*) FILTER (WHERE first) + 1) / 2.0")} AS statistic
FROM rk""").replace("\n, rk", ", rk"))
def q_mwu(spark, sf):
    return rounded(htest.two_sample_test(_li(spark, sf), "l_extendedprice", "l_linestatus", "F", "O", False)
                   .drop("p_value"))


@register("htest_mannwhitney_p")
def q_mwu_p(spark, sf):
    return htest.two_sample_test(_li(spark, sf), "l_extendedprice", "l_linestatus", "F", "O", False)


@register("htest_anova", f"""
WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events
           WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type),
a AS (SELECT sum(n) AS NN, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g)
SELECT 'ANOVA' AS test, CAST(k AS BIGINT) AS k, CAST(NN AS BIGINT) AS n,
  {r("(sum(n * (m - gm) ^ 2) / (k - 1)) / (sum(v * (n - 1)) / (NN - k))")} AS statistic
FROM g, a GROUP BY k, NN
""")
def q_anova(spark, sf):
    return rounded(htest.k_sample_test(table(spark, sf, "events"), "value", "event_type", True).drop("p_value"))


@register("htest_anova_p")
def q_anova_p(spark, sf):
    return htest.k_sample_test(table(spark, sf, "events"), "value", "event_type", True)


@register("htest_kruskal", f"""
WITH t AS (SELECT value AS v, event_type AS g FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
rk AS (SELECT g, {_rank_sql("v", "t")} AS rr FROM t),
rs AS (SELECT g, count(*) AS n, sum(rr) AS rsum FROM rk GROUP BY g),
ties AS (SELECT sum(c * c * c - c) AS tt FROM (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY v)),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS NN FROM t)
SELECT 'Kruskal-Wallis' AS test, CAST(count(*) AS BIGINT) AS k, CAST(any_value(NN) AS BIGINT) AS n,
  {r("(12.0 / (any_value(NN) * (any_value(NN) + 1)) * sum(rsum * rsum / n) - 3 * (any_value(NN) + 1)) / (1 - any_value(tt) / (any_value(NN) ^ 3 - any_value(NN)))")} AS statistic
FROM rs, ties, tot
""")
def q_kruskal(spark, sf):
    return rounded(htest.k_sample_test(table(spark, sf, "events"), "value", "event_type", False).drop("p_value"))


@register("htest_kruskal_p")
def q_kruskal_p(spark, sf):
    return htest.k_sample_test(table(spark, sf, "events"), "value", "event_type", False)


_CHI_SRC = "(SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL)"


@register("htest_chisquare", f"""
WITH c AS (SELECT a, b, count(*) AS o FROM {_CHI_SRC} GROUP BY a, b),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
n AS (SELECT sum(o) AS N, count(DISTINCT a) AS R, count(DISTINCT b) AS C FROM c)
SELECT 'chi-squared' AS test, CAST(any_value(N) AS BIGINT) AS n, CAST(any_value(R) AS BIGINT) AS rows,
  CAST(any_value(C) AS BIGINT) AS cols, CAST((any_value(R) - 1) * (any_value(C) - 1) AS BIGINT) AS dof,
  {r("sum(o * o / (ra * cb / N)) - any_value(N)")} AS statistic
FROM c JOIN ra USING (a) JOIN cb USING (b), n
""")
def q_chisq(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(htest.chi_square_test(o, "o_orderstatus", "o_orderpriority").drop("p_value"))


@register("htest_chisquare_p")
def q_chisq_p(spark, sf):
    return htest.chi_square_test(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


_Q2 = ("(SELECT l_linestatus AS a, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'AN' END AS b FROM lineitem)")


@register("htest_chisquare_yates", f"""
WITH t AS {_Q2},
c AS (SELECT sum((a = 'F' AND b = 'AN')::INT) AS n11, sum((a = 'F' AND b = 'R')::INT) AS n12,
             sum((a = 'O' AND b = 'AN')::INT) AS n21, sum((a = 'O' AND b = 'R')::INT) AS n22 FROM t),
e AS (SELECT *, n11 + n12 + n21 + n22 AS N FROM c),
cells AS (SELECT n11 AS o, (n11 + n12) * (n11 + n21) / N AS e FROM e UNION ALL SELECT n12, (n11 + n12) * (n12 + n22) / N FROM e
          UNION ALL SELECT n21, (n21 + n22) * (n11 + n21) / N FROM e UNION ALL SELECT n22, (n21 + n22) * (n12 + n22) / N FROM e)
SELECT 'chi-squared' AS test, CAST((SELECT N FROM e) AS BIGINT) AS n, CAST(2 AS BIGINT) AS rows, CAST(2 AS BIGINT) AS cols,
  CAST(1 AS BIGINT) AS dof, {r("sum((o + least(0.5, abs(e - o)) * sign(e - o) - e) ^ 2 / e)")} AS statistic FROM cells
""")
def q_chisq_yates(spark, sf):
    li = _li(spark, sf).select(F.col("l_linestatus").alias("a"),
                               F.expr("CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'AN' END").alias("b"))
    return rounded(htest.chi_square_test(li, "a", "b").drop("p_value"))


@register("htest_fisher", f"""
WITH t AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT 'Fisher exact' AS test, CAST(sum((a = 0 AND b = 0)::INT) AS BIGINT) AS n11, CAST(sum((a = 0 AND b = 1)::INT) AS BIGINT) AS n12,
  CAST(sum((a = 1 AND b = 0)::INT) AS BIGINT) AS n21, CAST(sum((a = 1 AND b = 1)::INT) AS BIGINT) AS n22,
  {r("sum((a = 0 AND b = 0)::INT) * sum((a = 1 AND b = 1)::INT) / (sum((a = 0 AND b = 1)::INT) * sum((a = 1 AND b = 0)::INT))")} AS statistic
FROM t
""")
def q_fisher(spark, sf):
    return rounded(htest.fisher_test(table(spark, sf, "labels"), "quality", "toxic").drop("p_value"))


@register("htest_fisher_p")
def q_fisher_p(spark, sf):
    return htest.fisher_test(table(spark, sf, "labels"), "quality", "toxic")


@register("htest_contingency", """
SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS count FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2
""")
def q_contingency(spark, sf):
    return htest.contingency_table(_li(spark, sf), "l_returnflag", "l_linestatus")


@register("htest_shapiro")
def q_shapiro(spark, sf):
    ev = table(spark, sf, "events")
    res = htest.shapiro_test(ev, "value", key=["event_id"])
    return spark.createDataFrame([("Shapiro-Wilk", int(res["n"]), float(res["statistic"]), float(res["p_value"]))],
                                 "test string, n long, statistic double, p_value double")


@register("htest_dagostino_stats", f"""
SELECT count(value) AS n, {r("skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1))")} AS g1,
  {r("kurtosis_pop(value)")} AS g2 FROM events WHERE value IS NOT NULL
""")
def q_dagostino(spark, sf):
    return rounded(htest.dagostino_stats(table(spark, sf, "events"), "value"))


def _fried_src(spark, sf):
    li = _li(spark, sf)
    return (li.groupBy("l_suppkey", "l_returnflag")
            .agg(F.avg("l_extendedprice").alias("v")))


_FRIED_SQL = "(SELECT l_suppkey AS blk, l_returnflag AS trt, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"


@register("htest_friedman", f"""
WITH t AS {_FRIED_SQL},
rk AS (SELECT blk, trt, v, {_rank_sql("v", "t", "blk")} AS rr, count(*) OVER (PARTITION BY blk, v) AS tc FROM t),
rs AS (SELECT trt, sum(rr) AS R FROM rk GROUP BY trt),
ti AS (SELECT coalesce(sum(tc * tc * tc - tc), 0) AS tt FROM (SELECT DISTINCT blk, v, CAST(tc AS DOUBLE) AS tc FROM rk WHERE tc > 1)),
d AS (SELECT CAST(count(DISTINCT blk) AS DOUBLE) AS nb FROM t)
SELECT 'Friedman' AS test, CAST(any_value(nb) AS BIGINT) AS n_blocks, CAST(count(*) AS BIGINT) AS k,
  {r("(12.0 / (count(*) * any_value(nb) * (count(*) + 1)) * sum(R * R) - 3 * any_value(nb) * (count(*) + 1)) / (1 - any_value(tt) / (count(*) * (count(*) * count(*) - 1) * any_value(nb)))")} AS statistic
FROM rs, ti, d
""")
def q_friedman(spark, sf):
    return rounded(htest.friedman_test(_fried_src(spark, sf), "l_suppkey", "l_returnflag", "v").drop("p_value"))


@register("htest_friedman_p")
def q_friedman_p(spark, sf):
    return htest.friedman_test(_fried_src(spark, sf), "l_suppkey", "l_returnflag", "v")


@register("htest_paired_t", f"""
SELECT 'paired t-test' AS test, count(*) AS n,
  {r("avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*)))")} AS statistic
FROM lineitem WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL
""")
def q_paired_t(spark, sf):
    return rounded(htest.paired_test(_li(spark, sf), "l_discount", "l_tax", True).drop("p_value"))


@register("htest_paired_t_p")
def q_paired_t_p(spark, sf):
    return htest.paired_test(_li(spark, sf), "l_discount", "l_tax", True)


@register("htest_wilcoxon", f"""
WITH d AS (SELECT round(l_tax - l_discount, 9) AS d FROM lineitem WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL),
nz AS (SELECT abs(d) AS ad, d > 0 AS pos FROM d WHERE d <> 0),
rk AS (SELECT pos, {_rank_sql("ad", "nz")} AS rr FROM nz)
SELECT 'Wilcoxon signed-rank' AS test, count(*) AS n,
  {r("least(sum(rr) FILTER (WHERE pos), sum(rr) FILTER (WHERE NOT pos))")} AS statistic FROM rk
""")
def q_wilcoxon(spark, sf):
    li = _li(spark, sf).select(F.col("l_discount").alias("a"),
                               (F.col("l_discount") + F.round(F.col("l_tax") - F.col("l_discount"), 9)).alias("b0"))
    # differences are rounded to 9 dp on both sides so float noise cannot split ties
    li = _li(spark, sf).select(F.lit(0.0).alias("a"), F.round(F.col("l_tax") - F.col("l_discount"), 9).alias("b"))
    return rounded(htest.paired_test(li, "a", "b", False).drop("p_value"))


@register("htest_wilcoxon_p")
def q_wilcoxon_p(spark, sf):
    li = _li(spark, sf).select(F.lit(0.0).alias("a"), F.round(F.col("l_tax") - F.col("l_discount"), 9).alias("b"))
    return htest.paired_test(li, "a", "b", False)


@register("htest_group_means", f"""
SELECT o_orderpriority AS "group", {r("avg(o_totalprice)")} AS mean, count(o_totalprice) AS n
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority
""")
def q_group_means(spark, sf):
    return rounded(htest.group_means(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@register("htest_smd", f"""
WITH t AS (SELECT l_quantity AS v, l_linestatus = 'F' AS first FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_quantity IS NOT NULL),
s AS (SELECT count(v) FILTER (WHERE first) AS n1, count(v) FILTER (WHERE NOT first) AS n2,
             avg(v) FILTER (WHERE first) AS m1, avg(v) FILTER (WHERE NOT first) AS m2,
             var_samp(v) FILTER (WHERE first) AS s1, var_samp(v) FILTER (WHERE NOT first) AS s2 FROM t)
SELECT n1, n2, {r("abs(m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2))")} AS smd FROM s
""")
def q_smd(spark, sf):
    return rounded(htest.smd(_li(spark, sf), "l_quantity", "l_linestatus", "F", "O"))


@register("htest_p_adjust", f"""
WITH t AS (SELECT s_name AS feature, (s_suppkey % 97) / 97.0 AS p_value FROM supplier),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS rnk, count(*) OVER () AS m FROM t)
SELECT feature, {r("p_value")} AS p_value, {r("least(1.0, p_value * m)")} AS p_bonferroni,
  {r("least(1.0, min(p_value * m / rnk) OVER (ORDER BY rnk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")} AS p_fdr_bh
FROM rk
""")
def q_p_adjust(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("feature"),
                                            ((F.col("s_suppkey") % 97) / 97.0).alias("p_value"))
    return rounded(htest.p_adjust(s, "p_value", "feature"))


def _miss_src(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_totalprice", "o_orderstatus",
                    F.expr("CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END").alias("cust"),
                    F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END").alias("prio"))


_MISS_SQL = ("(SELECT o_totalprice, o_orderstatus, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS cust, "
             "CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS prio FROM orders)")


@register("htest_missingness_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {r(f"avg(o_totalprice) FILTER (WHERE {c} IS NULL)")} AS mean_missing,
  {r(f"avg(o_totalprice) FILTER (WHERE {c} IS NOT NULL)")} AS mean_present,
  {r(f"abs(avg(o_totalprice) FILTER (WHERE {c} IS NULL) - avg(o_totalprice) FILTER (WHERE {c} IS NOT NULL))")} AS difference,
  count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} IS NOT NULL) AS n_present,
  't-test (ind.)' AS test,
  {r(f"(avg(o_totalprice) FILTER (WHERE {c} IS NULL) - avg(o_totalprice) FILTER (WHERE {c} IS NOT NULL)) / sqrt(((count(*) FILTER (WHERE {c} IS NULL) - 1) * var_samp(o_totalprice) FILTER (WHERE {c} IS NULL) + (count(*) FILTER (WHERE {c} IS NOT NULL) - 1) * var_samp(o_totalprice) FILTER (WHERE {c} IS NOT NULL)) / (count(*) - 2) * (1.0 / count(*) FILTER (WHERE {c} IS NULL) + 1.0 / count(*) FILTER (WHERE {c} IS NOT NULL)))")} AS statistic
FROM {_MISS_SQL} WHERE o_totalprice IS NOT NULL""" for c in ["cust", "prio"]))
def q_miss_num(spark, sf):
    return rounded(htest.missingness_vs_numeric(_miss_src(spark, sf), "o_totalprice", ["cust", "prio"], True)
                   .drop("p_value"))


@register("htest_missingness_class", " UNION ALL ".join(f"""
SELECT '{c}' AS "column",
  {r(f"(SELECT max(abs(coalesce(sm, 0) - coalesce(sp, 0))) FROM (SELECT o_orderstatus, avg(({c} IS NULL)::INT) AS x, sum(({c} IS NULL)::INT) / (SELECT sum(({c} IS NULL)::INT) FROM {_MISS_SQL}) AS sm, sum(({c} IS NOT NULL)::INT) / (SELECT sum(({c} IS NOT NULL)::INT) FROM {_MISS_SQL}) AS sp FROM {_MISS_SQL} GROUP BY o_orderstatus))")} AS max_class_diff,
  'chi-squared' AS test,
  {r(f"(SELECT sum(o * o / (rm * cy / N)) - any_value(N) FROM (SELECT o, sum(o) OVER (PARTITION BY m) AS rm, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS N FROM (SELECT {c} IS NULL AS m, o_orderstatus AS y, count(*) AS o FROM {_MISS_SQL} GROUP BY 1, 2)))")} AS statistic,
  CAST(2 AS BIGINT) AS dof""" for c in ["cust", "prio"]))
def q_miss_class(spark, sf):
    return rounded(htest.missingness_vs_class(_miss_src(spark, sf), "o_orderstatus", ["cust", "prio"])
                   .drop("p_value"))
