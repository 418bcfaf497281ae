"""Model computations (ops 126-146)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import models as md
from cohortspark.operators import split as sp
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rcol, rounded, table

FEATS = ["l_quantity", "l_discount", "l_tax"]


def _reg(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FEATS, "l_extendedprice")
    return sp.random_split(li, ["l_orderkey", "l_linenumber", "l_extendedprice"], 0.8, 0.0)


def _cls(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("log_chars"),
                                            (F.length("text") / F.greatest(F.col("n_chars"), F.lit(1))).alias("len_ratio"))
    t = lab.join(d, "doc_id").select("doc_id", "log_chars", "len_ratio", F.col("toxic").cast("double").alias("toxic"),
                                     F.col("quality").cast("double").alias("quality"))
    return sp.random_split(t, ["doc_id"], 0.7, 0.0)


def _emb(spark, sf, dims=64):
    e = table(spark, sf, "embeddings")
    t = e.select("vec_id", F.col("label").cast("double").alias("label"),
                 *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])
    return sp.random_split(t, ["vec_id"], 0.7, 0.0)


def _parts(df):
    return df.where(F.col("split") == "train"), df.where(F.col("split") != "train")


@register("model_ols_single", f"""
SELECT {r("regr_intercept(l_extendedprice, l_quantity)", 4)} AS intercept, {r("regr_slope(l_extendedprice, l_quantity)", 6)} AS slope
FROM lineitem
""")
def q_ols_single(spark, sf):
    m = md.fit_ols(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(rcol(F.lit(m.intercept), 4).alias("intercept"), rcol(F.lit(m.coef[0]), 6).alias("slope"))


@register("model_ridge_single", f"""
WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS sxx,
                  covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy FROM lineitem)
SELECT {r("my - mx * sxy / (sxx + 1000.0)", 4)} AS intercept, {r("sxy / (sxx + 1000.0)", 6)} AS slope FROM s
""")
def q_ridge_single(spark, sf):
    m = md.fit_ols(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", alpha=1000.0, name="ridge")
    return spark.range(1).select(rcol(F.lit(m.intercept), 4).alias("intercept"), rcol(F.lit(m.coef[0]), 6).alias("slope"))


@register("model_coefficient_table", f"""
SELECT term, {r("coefficient", 4)} AS coefficient, CAST(position AS BIGINT) AS position FROM (
  SELECT '(intercept)' AS term, regr_intercept(l_extendedprice, l_quantity) AS coefficient, 0 AS position FROM lineitem
  UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity), 1 FROM lineitem)
""")
def q_coef(spark, sf):
    m = md.fit_ols(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return rounded(md.coefficient_table(m), 4)


@register("model_weighted_huber_loss", f"""
SELECT {r("avg(least(greatest(1 + 2.5 * exp(-1.0 * power(((l_quantity * 4) - 180.0) / 20.0, 2)), 0.1), 10.0) * "
          "CASE WHEN abs(l_tax * 1000 - l_quantity * 4) <= 1 THEN 0.5 * (l_tax * 1000 - l_quantity * 4) ^ 2 "
          "ELSE abs(l_tax * 1000 - l_quantity * 4) - 0.5 END)")} AS weighted_huber FROM lineitem
""")
def q_whuber(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.agg(F.avg(md.weighted_huber_loss(F.col("l_tax") * 1000, F.col("l_quantity") * 4))
                          .alias("weighted_huber")))


@register("model_class_moments", f"""
WITH v AS (SELECT CAST(label AS DOUBLE) AS label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, count(*) AS n, {r("avg(x)")} AS mean, {r("var_pop(x)")} AS variance
FROM v GROUP BY label, dim
""")
def q_class_moments(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"),
                                              F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double")
    return rounded(e.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                                                 F.var_pop(x).alias("variance")))


def _fit_score(key, task, data_fn, feats, label, **params):
    def q(spark, sf):
        tr, te = _parts(data_fn(spark, sf))
        m = md.fit_model(key, tr, feats, label, task, **params)
        sc = md.score_model(m, te, label, task)
        return spark.createDataFrame([(key, *[float(v) if v is not None else None for v in sc.values()])],
                                     "model string, " + ", ".join(f"{c} double" for c in sc))
    return q


CLS_FEATS = ["log_chars", "len_ratio", "toxic"]
EMB_FEATS = [f"e{i}" for i in range(64)]

for _key, _task, _fn, _f, _y, _p in [
    ("ridge", "regression", _reg, FEATS, "l_extendedprice", {}),
    ("lasso", "regression", _reg, FEATS, "l_extendedprice", {"alpha": 10.0}),
    ("elasticnet", "regression", _reg, FEATS, "l_extendedprice", {}),
    ("huber", "regression", _reg, FEATS, "l_extendedprice", {}),
    ("glm", "regression", _reg, FEATS, "l_extendedprice", {}),
    ("rf", "regression", _reg, FEATS, "l_extendedprice", {"n_trees": 20, "max_depth": 6}),
    ("extratrees", "regression", _reg, FEATS, "l_extendedprice", {"n_trees": 20, "max_depth": 8}),
    ("histgb", "regression", _reg, FEATS, "l_extendedprice", {"rounds": 20}),
    ("knn", "regression", _cls, ["log_chars", "len_ratio"], "quality", {}),
    ("logreg", "classification", _cls, CLS_FEATS, "quality", {}),
    ("glm", "classification", _cls, CLS_FEATS, "quality", {}),
    ("svc", "classification", _cls, CLS_FEATS, "quality", {"max_iter": 25}),
    ("gaussian_nb", "classification", _emb, EMB_FEATS, "label", {}),
    ("lda", "classification", _emb, EMB_FEATS, "label", {}),
    ("knn", "classification", _emb, EMB_FEATS, "label", {}),
    ("nn", "classification", _emb, EMB_FEATS, "label", {}),
    ("histgb", "classification", _cls, CLS_FEATS, "quality", {"rounds": 10}),
    ("svr", "regression", _reg, FEATS, "l_extendedprice", {}),
    ("svc_rbf", "classification", _cls, CLS_FEATS, "quality", {"max_iter": 25}),
]:
    register(f"model_fit_{_key}_{_task[:3]}")(_fit_score(_key, _task, _fn, _f, _y, **_p))


@register("model_baselines")
def q_baselines(spark, sf):
    tr, te = _parts(_reg(spark, sf))
    rows = []
    for m in md.baselines(tr, te, FEATS, "l_extendedprice", "regression"):
        sc = md.score_model(m, te, "l_extendedprice", "regression")
        rows.append((m.name, float(sc["rmse"]), float(sc["mae"]), float(sc["r2"])))
    return spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double")


@register("model_fit_all_ranked")
def q_fit_all(spark, sf):
    tr, te = _parts(_reg(spark, sf))
    return md.fit_all(["ridge", "huber", "rf"], tr, te, FEATS, "l_extendedprice", "regression",
                      {"rf": {"n_trees": 10, "max_depth": 5}})


@register("model_random_search")
def q_search(spark, sf):
    d = _reg(spark, sf)
    tr, te = _parts(d)
    return md.random_search("ridge", tr, te, FEATS, "l_extendedprice", "regression", trials=4)


@register("model_external_validation")
def q_external(spark, sf):
    tr, te = _parts(_reg(spark, sf))
    m = md.fit_model("ridge", tr, FEATS, "l_extendedprice", "regression")
    return md.external_validation(m, te, "l_extendedprice", "regression",
                                  key=["l_orderkey", "l_linenumber", "l_extendedprice"])


@register("model_quick_probe")
def q_probe(spark, sf):
    """Constant, OLS and a small forest on an 80/20 hash split (op 142)."""
    tr, te = _parts(_reg(spark, sf))
    rows = []
    for name, m in [("constant", md.fit_mean(tr, FEATS, "l_extendedprice")),
                    ("ols", md.fit_ols(tr, FEATS, "l_extendedprice")),
                    ("rf_small", md.fit_forest(tr, FEATS, "l_extendedprice", n_trees=10, max_depth=3))]:
        sc = md.score_model(m, te, "l_extendedprice", "regression")
        rows.append((name, float(sc["rmse"]), float(sc["r2"])))
    return spark.createDataFrame(rows, "model string, rmse double, r2 double")


@register("model_cross_validation")
def q_cv(spark, sf):
    d = _reg(spark, sf)
    return md.cross_validate("ridge", d, FEATS, "l_extendedprice", "regression", 5,
                             row_key=["l_orderkey", "l_linenumber", "l_extendedprice"])


@register("model_cross_validation_stratified")
def q_cv_strat(spark, sf):
    return md.cross_validate("logreg", _cls(spark, sf), CLS_FEATS, "quality", "classification", 5,
                             row_key=["doc_id"], stratify=True)
