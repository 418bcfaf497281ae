"""Table 1 computations (op 92)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import table1
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table

CFG = table1.Table1Config(grouping_var="l_linestatus",
                          continuous_vars=["l_quantity", "l_extendedprice", "l_discount"],
                          categorical_vars=["l_returnflag", "l_shipmode"], show_smd=True)


def _src(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_linestatus", F.expr("nullif(l_quantity, 1.0)").alias("l_quantity"), "l_extendedprice",
                     "l_discount", "l_returnflag",
                     F.expr("CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'AIR' "
                            "ELSE 'SHIP' END").alias("l_shipmode"))


_SRC = ("(SELECT l_linestatus AS grp, nullif(l_quantity, 1.0) AS l_quantity, l_extendedprice, l_discount, l_returnflag, "
        "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'AIR' ELSE 'SHIP' END AS l_shipmode FROM lineitem)")


def _long_sql(cols, cast):
    return " UNION ALL ".join(f"SELECT grp, '{c}' AS variable, CAST({c} AS {cast}) AS value FROM {_SRC}" for c in cols)


@register("table1_continuous", f"""
WITH l AS ({_long_sql(["l_quantity", "l_extendedprice", "l_discount"], "DOUBLE")})
SELECT variable, CASE WHEN grouping(grp) = 1 THEN 'Overall' ELSE grp END AS stratum,
  count(*) AS n_total, count(value) AS n, CAST(sum((value IS NULL)::INT) AS BIGINT) AS missing,
  {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS sd, {r("quantile_cont(value, 0.25)")} AS q1,
  {r("quantile_cont(value, 0.5)")} AS median, {r("quantile_cont(value, 0.75)")} AS q3
FROM l GROUP BY GROUPING SETS ((variable, grp), (variable))
""")
def q_continuous(spark, sf):
    return rounded(table1.continuous_stats(_src(spark, sf), CFG).drop("g1", "g2"))


@register("table1_categorical", f"""
WITH l AS ({_long_sql(["l_returnflag", "l_shipmode"], "VARCHAR")}),
c AS (SELECT variable, CASE WHEN grouping(grp) = 1 THEN 'Overall' ELSE grp END AS stratum, value AS level, count(*) AS count
      FROM l GROUP BY GROUPING SETS ((variable, grp, value), (variable, value)))
SELECT variable, stratum, level, count,
  {r("CASE WHEN level IS NOT NULL THEN count * 100.0 / sum(CASE WHEN level IS NOT NULL THEN count ELSE 0 END) OVER (PARTITION BY variable, stratum) END")} AS pct,
  CAST(sum(CASE WHEN level IS NULL THEN count ELSE 0 END) OVER (PARTITION BY variable, stratum) AS BIGINT) AS missing,
  CAST(sum(count) OVER (PARTITION BY variable, stratum) AS BIGINT) AS n_total
FROM c
""")
def q_categorical(spark, sf):
    return rounded(table1.categorical_counts(_src(spark, sf), CFG))


@register("table1_cells")
def q_cells(spark, sf):
    cells, _tests = table1.generate_table1(_src(spark, sf), CFG)
    return cells


@register("table1_tests")
def q_tests(spark, sf):
    _cells, tests = table1.generate_table1(_src(spark, sf), CFG)
    return tests
