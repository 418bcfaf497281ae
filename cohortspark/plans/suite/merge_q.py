"""Merge and join-diagnostic computations (ops 29-35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import joins
from cohortspark.plans.merge import MergePlan, MergeStep, merge
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table


def _star(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"),
                                            F.col("c_nationkey").alias("nationkey"), "c_acctbal",
                                            F.col("c_name").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"),
                                          F.col("n_regionkey").alias("regionkey"), F.col("n_name").alias("name"))
    rg = table(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("name"))
    return {"orders": o, "customer": c, "nation": n, "region": rg}


@register("merge_chain_inner", f"""
SELECT o.custkey, o.o_orderkey, {r("o.o_totalprice")} AS o_totalprice, c.nationkey, {r("c.c_acctbal")} AS c_acctbal,
       c.name AS name_x, n.regionkey, n.name AS name_y
FROM (SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders) o
JOIN (SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal, c_name AS name FROM customer) c
  ON o.custkey IS NOT DISTINCT FROM c.custkey
JOIN (SELECT n_nationkey AS nationkey, n_regionkey AS regionkey, n_name AS name FROM nation) n
  ON c.nationkey IS NOT DISTINCT FROM n.nationkey
""")
def q_chain_inner(spark, sf):
    plan = (MergePlan().add("orders", "customer", on="custkey", how="inner")
            .add("result", "nation", on="nationkey", how="inner"))
    return rounded(plan.apply(_star(spark, sf)))


@register("merge_chain_left_region", """
SELECT c.nationkey, n.regionkey, n.name AS name_x, rg.name AS name_y
FROM (SELECT c_nationkey AS nationkey FROM customer) c
JOIN (SELECT n_nationkey AS nationkey, n_regionkey AS regionkey, n_name AS name FROM nation) n
  ON c.nationkey IS NOT DISTINCT FROM n.nationkey
LEFT JOIN (SELECT CASE WHEN r_name LIKE 'A%' THEN NULL ELSE r_regionkey END AS regionkey, r_name AS name FROM region) rg
  ON n.regionkey IS NOT DISTINCT FROM rg.regionkey
""")
def q_chain_left(spark, sf):
    """Inner then left join; regions named A... have no key on the right and find no partner."""
    t = _star(spark, sf)
    t = {"customer": t["customer"].select("nationkey"), "nation": t["nation"],
         "region": t["region"].withColumn("regionkey", F.expr("CASE WHEN name LIKE 'A%' THEN NULL ELSE regionkey END"))}
    plan = MergePlan([MergeStep("customer", "nation", on="nationkey", how="inner"),
                      MergeStep("result", "region", on="regionkey", how="left")])
    return plan.apply(t)


@register("merge_outer_nullsafe", """
SELECT coalesce(a.k, b.k) AS k, a.v_left, b.n_customers FROM
(SELECT n_nationkey AS k, n_name AS v_left FROM nation) a
FULL OUTER JOIN
(SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS k, count(*) AS n_customers FROM customer GROUP BY 1) b
ON a.k IS NOT DISTINCT FROM b.k
""")
def q_outer(spark, sf):
    """Customers in debit get a missing nation key; NULL keys still meet NULL keys."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v_left"))
    c = table(spark, sf, "customer")
    b = (c.select(F.expr("CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END").alias("k"))
         .groupBy("k").agg(F.count(F.lit(1)).alias("n_customers")))
    return merge(n, b, on="k", how="outer")


@register("merge_right_suffix", """
SELECT s.s_nationkey AS nationkey_l, n.n_nationkey AS nationkey, s.s_name AS name, n.n_name AS name_2
FROM (SELECT s_nationkey, s_name FROM supplier) s
RIGHT JOIN nation n ON s.s_nationkey IS NOT DISTINCT FROM n.n_nationkey
""")
def q_right_suffix(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey_l"), F.col("s_name").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    return merge(s, n, left_on="nationkey_l", right_on="nationkey", how="right", suffixes=("", "_2"))


@register("merge_key_overlap", """
SELECT count(*) AS overlap FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL
  INTERSECT SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
""")
def q_overlap(spark, sf):
    return joins.key_overlap(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey")


@register("merge_hot_keys", """
SELECT o_custkey AS key, count(*) AS rows FROM orders GROUP BY o_custkey ORDER BY rows DESC, key NULLS FIRST LIMIT 10
""")
def q_hot_keys(spark, sf):
    return joins.hot_keys(table(spark, sf, "orders"), "o_custkey", 10)


def _pair_sql(lt, rt, lsrc, rsrc, c, score):
    return f"""SELECT '{lt}' AS left_table, '{rt}' AS right_table, '{c}' AS "column", {score} AS name_score,
  CAST((SELECT count(*) FROM (SELECT {c} FROM {lsrc} WHERE {c} IS NOT NULL INTERSECT SELECT {c} FROM {rsrc} WHERE {c} IS NOT NULL)) AS BIGINT) AS overlap,
  {r(f"(SELECT count(DISTINCT {c}) / count({c}) FROM {lsrc})")} AS unique_left,
  {r(f"(SELECT count(DISTINCT {c}) / count({c}) FROM {rsrc})")} AS unique_right,
  {r(f"((SELECT count(*) - count({c}) FROM {lsrc}) + (SELECT count(*) - count({c}) FROM {rsrc})) / ((SELECT count(*) FROM {lsrc}) + (SELECT count(*) FROM {rsrc}))")} AS null_share,
  {r(f"(SELECT count(*) FROM {lsrc} a JOIN {rsrc} b USING ({c})) / (SELECT count(*) FROM {lsrc})")} AS row_multiplier"""


_OL = "(SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status FROM orders)"
_LL = "(SELECT l_orderkey AS orderkey, l_linestatus AS status FROM lineitem)"


@register("merge_suggest_keys", _pair_sql("orders", "lineitem", _OL, _LL, "orderkey", 0.6)
          + "\nUNION ALL\n" + _pair_sql("orders", "lineitem", _OL, _LL, "status", 0.0))
def q_suggest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
                                         F.col("o_orderstatus").alias("status"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("status"))
    return rounded(joins.suggest_join_keys({"orders": o, "lineitem": li}))
