"""Preprocessing and split computations (ops 70-70g, 105-118c)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import preprocess as pp
from cohortspark.operators import split as sp
from cohortspark.plans.pipeline import PreprocessConfig, fit_pipeline, legacy_prepare
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table


def _li(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.expr("nullif(l_quantity, 1.0)").alias("qty"), "l_extendedprice", "l_discount",
                     F.expr("nullif(l_tax, 0.0)").alias("tax"), "l_returnflag",
                     F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END").alias("status"))


_LI = ("(SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1.0) AS qty, l_extendedprice, l_discount, "
       "nullif(l_tax, 0.0) AS tax, l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS status "
       "FROM lineitem)")


@register("prep_impute_median", f"""
SELECT l_orderkey, l_linenumber, {r("coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM " + _LI + "))")} AS qty,
  {r("coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM " + _LI + "))")} AS tax
FROM {_LI}
""")
def q_impute_median(spark, sf):
    d = _li(spark, sf).select("l_orderkey", "l_linenumber", "qty", "tax")
    return rounded(pp.fit_numeric_imputer(d, ["qty", "tax"], "median").transform(d))


@register("prep_impute_mean_indicators", f"""
SELECT l_orderkey, l_linenumber, {r("coalesce(qty, (SELECT avg(qty) FROM " + _LI + "))")} AS qty,
  {r("coalesce(tax, (SELECT avg(tax) FROM " + _LI + "))")} AS tax,
  CAST(qty IS NULL AS DOUBLE) AS missingindicator_qty, CAST(tax IS NULL AS DOUBLE) AS missingindicator_tax
FROM {_LI}
""")
def q_impute_mean(spark, sf):
    d = _li(spark, sf).select("l_orderkey", "l_linenumber", "qty", "tax")
    return rounded(pp.fit_numeric_imputer(d, ["qty", "tax"], "mean", add_indicator=True).transform(d))


@register("prep_impute_constant", f"""
SELECT l_orderkey, l_linenumber, coalesce(qty, 0.0) AS qty, coalesce(tax, 0.0) AS tax FROM {_LI}
""")
def q_impute_const(spark, sf):
    d = _li(spark, sf).select("l_orderkey", "l_linenumber", "qty", "tax")
    return pp.fit_numeric_imputer(d, ["qty", "tax"], "constant").transform(d)


@register("prep_log1p", f"""
SELECT l_orderkey, l_linenumber, {r("ln(1 + greatest(l_extendedprice - 50000, 0))")} AS x FROM lineitem
""")
def q_log1p(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 50000).alias("x"))
    return rounded(pp.Log1p(["x"]).transform(d))


@register("prep_yeo_johnson")
def q_yeo(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000.0 - 100).alias("x"))
    m = pp.fit_yeo_johnson(d, ["x"])
    return m.transform(d).withColumn("lambda", F.lit(m.lambdas["x"]))


@register("prep_cap_percentile", f"""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, {r("least(greatest(l_extendedprice, lo), hi)")} AS l_extendedprice FROM lineitem, b
""")
def q_cap_pct(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(pp.fit_outlier_capping(d, ["l_extendedprice"], "percentile").transform(d))


@register("prep_cap_mad", f"""
WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM orders),
d AS (SELECT quantile_cont(abs(o_totalprice - med), 0.5) AS mad, med FROM orders, m GROUP BY med)
SELECT o_orderkey, {r("least(greatest(o_totalprice, med - 3.5 * 1.4826 * mad), med + 3.5 * 1.4826 * mad)")} AS o_totalprice FROM orders, d
""")
def q_cap_mad(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(pp.fit_outlier_capping(d, ["o_totalprice"], "mad").transform(d))


@register("prep_standard_scale", f"""
SELECT o_orderkey, {r("(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)")} AS o_totalprice,
  {r("(CAST(o_custkey AS DOUBLE) - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders)")} AS o_custkey
FROM orders
""")
def q_standard(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(pp.fit_scaler(d, ["o_totalprice", "o_custkey"], "standard").transform(d))


@register("prep_robust_scale", f"""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders)
SELECT o_orderkey, {r("(o_totalprice - med) / iqr")} AS o_totalprice FROM orders, b
""")
def q_robust(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(pp.fit_scaler(d, ["o_totalprice"], "robust").transform(d))


@register("prep_minmax_scale", f"""
WITH b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, {r("(o_totalprice - mn) / (mx - mn)")} AS o_totalprice FROM orders, b
""")
def q_minmax(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(pp.fit_scaler(d, ["o_totalprice"], "minmax").transform(d))


@register("prep_categorical_impute", f"""
WITH m AS (SELECT status AS mode FROM {_LI} WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(status, (SELECT mode FROM m)) AS status FROM {_LI}
""")
def q_cat_impute(spark, sf):
    d = _li(spark, sf).select("l_orderkey", "l_linenumber", "status")
    return pp.fit_categorical_imputer(d, ["status"]).transform(d)


@register("prep_one_hot", """
SELECT o_orderkey, CAST(coalesce(o_orderstatus = 'O', false) AS DOUBLE) AS o_orderstatus_O,
  CAST(coalesce(o_orderstatus = 'P', false) AS DOUBLE) AS o_orderstatus_P,
  CAST(coalesce(o_orderstatus = 'F', false) AS DOUBLE) AS o_orderstatus_F,
  CAST(coalesce(flag = 'Y', false) AS DOUBLE) AS flag_Y
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag FROM orders)
""")
def q_one_hot(spark, sf):
    d = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'Y' ELSE 'N' END").alias("flag"))
    return pp.fit_one_hot(d, ["o_orderstatus", "flag"]).transform(d)


@register("prep_ordinal", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE -1 END AS DOUBLE) AS o_orderpriority FROM orders
""")
def q_ordinal(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return pp.fit_ordinal(d, ["o_orderpriority"]).transform(d)


@register("prep_label_encode", """
SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS l_returnflag
FROM lineitem
""")
def q_label(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return pp.fit_label_encoder(d, "l_returnflag").transform(d)


@register("prep_target_encode_plain", f"""
WITH s AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders),
c AS (SELECT o_orderpriority AS lv, count(*) AS n, avg(o_totalprice) AS mc, greatest(var_pop(o_totalprice), 0) AS vc FROM orders GROUP BY 1)
SELECT o_orderkey, {r("(n * v / (n * v + vc)) * mc + (1 - n * v / (n * v + vc)) * m", 4)} AS o_orderpriority
FROM orders JOIN c ON o_orderpriority = lv, s
""")
def q_target_plain(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    enc, _ = pp.fit_target_encoder(d, ["o_orderpriority"], "o_totalprice", key=["o_orderkey"])
    return rounded(enc.transform(d.select("o_orderkey", "o_orderpriority")), 4)


@register("prep_target_encode_oof")
def q_target_oof(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    _enc, oof = pp.fit_target_encoder(d, ["o_orderpriority"], "o_totalprice", key=["o_orderkey"])
    return oof


@register("prep_iterative_impute")
def q_iterative(spark, sf):
    d = _li(spark, sf).select("l_orderkey", "l_linenumber", "qty", "l_extendedprice", "tax")
    return pp.fit_iterative_imputer(d, ["qty", "l_extendedprice", "tax"]).transform(d)


@register("prep_pca")
def q_pca(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return pp.fit_pca(d, [f"e{i}" for i in range(64)], 0.8).transform(d)


@register("prep_kmeans_features")
def q_kmeans(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return pp.fit_kmeans_features(d, [f"e{i}" for i in range(64)], 5, add_onehot=True).transform(d)


@register("prep_pipeline")
def q_pipeline(spark, sf):
    d = _li(spark, sf)
    cfg = PreprocessConfig(numeric_features=["qty", "l_extendedprice", "tax"], categorical_features=["status", "l_returnflag"],
                           numeric_outlier_treatment="percentile", numeric_missing_indicators=True)
    fp = fit_pipeline(d, cfg, keep=["l_orderkey", "l_linenumber"])
    return fp.features(d)


# ---------------------------------------------------------------------- splits

@register("split_random")
def q_split_random(spark, sf):
    return sp.random_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]) \
        .groupBy("split").count()


@register("split_stratified_counts", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT quality, part AS split, CAST(k AS BIGINT) AS count FROM (
  SELECT quality, 'train' AS part, floor(n * 0.7) AS k FROM c
  UNION ALL SELECT quality, 'val', floor(n * 0.15) FROM c
  UNION ALL SELECT quality, 'test', n - floor(n * 0.7) - floor(n * 0.15) FROM c) WHERE k > 0
""")
def q_split_strat(spark, sf):
    lab = table(spark, sf, "labels")
    return sp.stratified_split(lab, "quality", ["doc_id"]).groupBy("quality", "split").count()


@register("split_group_leakage", """
SELECT CAST(0 AS BIGINT) AS leaking_entities, CAST(count(DISTINCT user_id) AS BIGINT) AS entities FROM events
""")
def q_split_group(spark, sf):
    s = sp.group_split(table(spark, sf, "events"), "user_id")
    per = s.groupBy("user_id").agg(F.count_distinct("split").alias("k"))
    return per.agg(F.sum((F.col("k") > 1).cast("long")).alias("leaking_entities"),
                   F.count(F.lit(1)).alias("entities"))


@register("split_time", """
SELECT event_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
""")
def q_split_time(spark, sf):
    return sp.time_split(table(spark, sf, "events"), "ts", "event_id").select("event_id", "split")


@register("split_stratified_kfold_counts", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT toxic, CAST(f AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS count
FROM c, range(5) t(f) WHERE n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END > 0
""")
def q_skfold(spark, sf):
    return sp.stratified_kfold(table(spark, sf, "labels"), "toxic", 5, ["doc_id"]).groupBy("toxic", "fold").count()


@register("split_kfold")
def q_kfold(spark, sf):
    return sp.kfold(table(spark, sf, "orders"), 5, ["o_orderkey"]).groupBy("fold").count()


@register("split_bootstrap_weights")
def q_boot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    reps = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"))
    w = reps.withColumn("w", sp.bootstrap_weight(F.col("rep"), 42, F.col("o_orderkey")))
    return w.groupBy("rep").agg(F.sum("w").alias("total_weight"), F.avg("w").alias("mean_weight"))


@register("split_subsample")
def q_subsample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("rep"))
    return (o.withColumn("in", sp.subsample_flag(F.col("rep"), 42, F.col("o_orderkey")))
            .groupBy("rep").agg(F.avg(F.col("in").cast("double")).alias("share")))


@register("prep_legacy_prepare")
def q_legacy(spark, sf):
    d = _li(spark, sf)
    return legacy_prepare(d, "l_extendedprice", ["qty", "tax", "l_discount"], key=["l_orderkey", "l_linenumber"])
