"""Audit computations (ops 15-42) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import audit
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table, union_sql

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li_nulls(spark, sf):
    """lineitem slice with derived NULLs and many duplicate rows."""
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linestatus",
                     F.expr("nullif(l_linenumber, 3)").alias("l_linenumber"),
                     F.expr("nullif(l_quantity, 1.0)").alias("l_quantity"))


LI_NULLS_SQL = ("(SELECT l_returnflag, l_linestatus, nullif(l_linenumber, 3) AS l_linenumber, "
                "nullif(l_quantity, 1.0) AS l_quantity FROM lineitem)")


@register("audit_table_summary", f"""
WITH t AS {LI_NULLS_SQL}
SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols,
       CAST(sum((l_linenumber IS NULL)::INT + (l_quantity IS NULL)::INT) AS BIGINT) AS missing_cells,
       {r("sum((l_linenumber IS NULL)::INT + (l_quantity IS NULL)::INT) * 100.0 / (count(*) * 4)")} AS missing_pct,
       CAST(2 AS BIGINT) AS numeric_cols,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS BIGINT) AS duplicate_rows
FROM t
""")
def q_table_summary(spark, sf):
    return rounded(audit.table_summary(li_nulls(spark, sf)))


@register("audit_orientation", """
SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols,
       CASE WHEN 6 > 2 * count(*) AND 6 > 10 THEN 'wide'
            WHEN count(*) > 60 AND count(*) > 100 THEN 'tall' ELSE 'normal' END AS orientation
FROM orders
""")
def q_orientation(spark, sf):
    return audit.orientation(table(spark, sf, "orders"))


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def _card_sql(c):
    return f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique,
  {r(f"count(DISTINCT {c}) * 100.0 / count(*)")} AS pct_unique,
  CASE WHEN count(DISTINCT {c}) = 1 THEN 'Constant'
       WHEN count(DISTINCT {c}) = 2 THEN 'Binary'
       WHEN count(DISTINCT {c}) = count(*) THEN 'Unique (potential ID)'
       WHEN count(DISTINCT {c}) <= 10 THEN 'Low cardinality'
       WHEN count(DISTINCT {c}) <= 50 THEN 'Moderate cardinality'
       WHEN count(DISTINCT {c}) * 100.0 / count(*) > 90 THEN 'High cardinality (near-unique)'
       ELSE 'High cardinality' END AS cardinality
FROM orders"""


@register("audit_cardinality", union_sql([_card_sql(c) for c in ORDERS_COLS]))
def q_cardinality(spark, sf):
    return rounded(audit.cardinality_table(table(spark, sf, "orders")))


def cust_mixed(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal",
                    F.expr("CASE WHEN c_custkey % 7 = 0 THEN CAST(c_acctbal AS STRING) "
                           "ELSE c_name END").alias("c_code"),
                    F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))


CUST_MIXED_SQL = ("(SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 "
                  "THEN CAST(c_acctbal AS VARCHAR) ELSE c_name END AS c_code, "
                  "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)")


def _types_sql():
    spec = [("c_custkey", "bigint", False), ("c_nationkey", "int", False),
            ("c_acctbal", "double", False), ("c_code", "string", True),
            ("c_mktsegment", "string", True)]
    parts = []
    for c, t, is_str in spec:
        mixed = (f"coalesce(count(TRY_CAST({c} AS DOUBLE)) > 0 AND "
                 f"count(TRY_CAST({c} AS DOUBLE)) < count({c}), false)") if is_str else "false"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null,
  CAST(sum(({c} IS NULL)::INT) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique,
  {mixed} AS mixed_types FROM {CUST_MIXED_SQL}""")
    return union_sql(parts)


@register("audit_type_validity", _types_sql())
def q_types(spark, sf):
    return audit.type_validity_table(cust_mixed(spark, sf))


@register("audit_missing", f"""
WITH t AS {LI_NULLS_SQL}
SELECT * FROM (
  SELECT 'l_linenumber' AS "column", CAST(sum((l_linenumber IS NULL)::INT) AS BIGINT) AS missing_count,
         {r("sum((l_linenumber IS NULL)::INT) * 100.0 / count(*)")} AS missing_pct FROM t
  UNION ALL
  SELECT 'l_quantity', CAST(sum((l_quantity IS NULL)::INT) AS BIGINT),
         {r("sum((l_quantity IS NULL)::INT) * 100.0 / count(*)")} FROM t
  UNION ALL
  SELECT 'l_returnflag', CAST(sum((l_returnflag IS NULL)::INT) AS BIGINT),
         {r("sum((l_returnflag IS NULL)::INT) * 100.0 / count(*)")} FROM t
  UNION ALL
  SELECT 'l_linestatus', CAST(sum((l_linestatus IS NULL)::INT) AS BIGINT),
         {r("sum((l_linestatus IS NULL)::INT) * 100.0 / count(*)")} FROM t
) WHERE missing_count > 0
""")
def q_missing(spark, sf):
    return rounded(audit.missing_table(li_nulls(spark, sf)))


@register("audit_duplicate_groups", """
SELECT o_custkey, o_orderstatus, count(*) AS n_copies
FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1
""")
def q_duplicate_groups(spark, sf):
    return audit.duplicate_groups(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@register("audit_duplicate_sample", f"""
WITH t AS {LI_NULLS_SQL},
g AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, count(*) AS k
      FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM g, range(k)
ORDER BY l_returnflag, l_linestatus, l_linenumber NULLS FIRST, l_quantity NULLS FIRST LIMIT 10
""")
def q_duplicate_sample(spark, sf):
    return audit.duplicate_rows_sample(li_nulls(spark, sf), 10)


def _numsum_sql(c, src="lineitem"):
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f"avg({c})")} AS mean,
  {r(f"stddev_samp({c})")} AS std, {r(f"min({c})")} AS min,
  {r(f"quantile_cont({c}, 0.25)")} AS q25, {r(f"quantile_cont({c}, 0.5)")} AS median,
  {r(f"quantile_cont({c}, 0.75)")} AS q75, {r(f"max({c})")} AS max,
  {r(f"skewness({c})")} AS skewness, {r(f"kurtosis({c})")} AS kurtosis FROM {src}"""


@register("audit_numeric_summary", union_sql([_numsum_sql(c) for c in LI_NUM]))
def q_numeric_summary(spark, sf):
    return rounded(audit.numeric_summary(table(spark, sf, "lineitem"), LI_NUM))


def _iqr_sql(c, src="lineitem"):
    return f"""SELECT '{c}' AS "column", {r("lo")} AS lower, {r("hi")} AS upper,
  CAST(sum(({c} < lo OR {c} > hi)::INT) AS BIGINT) AS outlier_count,
  {r(f"sum(({c} < lo OR {c} > hi)::INT) * 100.0 / count(*)")} AS outlier_pct,
  sum(({c} < lo OR {c} > hi)::INT) > count(*) * 0.05 AS flagged
FROM {src}, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
                    quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi
             FROM {src}) b GROUP BY lo, hi"""


@register("audit_iqr_flags", union_sql([_iqr_sql(c) for c in LI_NUM]))
def q_iqr_flags(spark, sf):
    return rounded(audit.iqr_outlier_flags(table(spark, sf, "lineitem"), LI_NUM))


@register("audit_column_classes", union_sql([
    f"""SELECT '{c}' AS "column", '{k}' AS kind, count({c}) > 0 AS selectable FROM {CUST_MIXED_SQL}"""
    for c, k in [("c_custkey", "numeric"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
                 ("c_code", "categorical"), ("c_mktsegment", "categorical")]]))
def q_column_classes(spark, sf):
    return audit.column_classes(cust_mixed(spark, sf))


@register("audit_simple_impute", f"""
WITH t AS {LI_NULLS_SQL}
SELECT l_returnflag, l_linestatus,
       CAST(coalesce(l_linenumber, (SELECT quantile_cont(l_linenumber, 0.5) FROM t)) AS INTEGER) AS l_linenumber,
       {r("coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t))")} AS l_quantity
FROM t
""")
def q_simple_impute(spark, sf):
    return rounded(audit.simple_impute(li_nulls(spark, sf)))


@register("audit_drop_high_missing", """
SELECT o_orderkey, o_custkey, o_totalprice FROM
(SELECT o_orderkey, o_custkey, o_totalprice,
        CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderstatus END AS sparse FROM orders)
""")
def q_drop_high_missing(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select("o_orderkey", "o_custkey", "o_totalprice",
                 F.expr("CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderstatus END").alias("sparse"))
    return audit.drop_high_missing_columns(t)


@register("audit_drop_constant", """
SELECT o_orderkey, o_totalprice FROM orders
""")
def q_drop_constant(spark, sf):
    o = table(spark, sf, "orders")
    return audit.drop_constant_columns(o.select("o_orderkey", F.lit("x").alias("const_col"),
                                                "o_totalprice"))


@register("audit_drop_duplicates", """
SELECT DISTINCT o_custkey, o_orderstatus FROM orders
""")
def q_drop_duplicates(spark, sf):
    return audit.drop_duplicate_rows(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@register("audit_target_present", f"""
WITH t AS {LI_NULLS_SQL} SELECT * FROM t WHERE l_quantity IS NOT NULL
""")
def q_target_present(spark, sf):
    return audit.drop_missing_target(li_nulls(spark, sf), "l_quantity")


@register("audit_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5
""")
def q_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return audit.preview(o, 5, ["o_orderkey"])
