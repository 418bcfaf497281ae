"""Evaluation metrics and result tables (ops 147-158).

Every metric is an aggregation over (y, prediction[, score]) columns; ranks
for AUC and cumulative counts for average precision use the distributed
position primitive over distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import q
from cohortspark.functions.quantiles import column_quantiles
from cohortspark.operators import htest
from cohortspark.operators.ranks import value_positions

EPS = 2.220446049250313e-16  # float64 machine epsilon (probability clipping)


def _pairs(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.select(q(y).cast("double").alias("y"), q(yhat).cast("double").alias("p")).dropna()


# ------------------------------------------------------------ regression (147)

def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """n, MAE, RMSE, R², MedianAE in one aggregation."""
    t = _pairs(df, y, yhat)
    e = F.col("y") - F.col("p")
    median = column_quantiles(t, {"e": F.abs(e)}, [0.5])["e"][0]
    st = t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
               F.var_pop("y").alias("vy"), F.lit(median).cast("double").alias("medae"))
    return st.select(F.col("n").cast("long").alias("n"), "mae", F.sqrt("mse").alias("rmse"),
                     (1 - F.col("mse") / F.col("vy")).alias("r2"), F.col("medae").alias("median_ae"))


# -------------------------------------------------------- classification (148-151)

def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Long confusion matrix: (actual, predicted, count)."""
    return (df.where(q(y).isNotNull() & q(yhat).isNotNull())
            .groupBy(q(y).cast("string").alias("actual"), q(yhat).cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def per_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per label: support, precision, recall, F1 (0 where undefined)."""
    cc = confusion_counts(df, y, yhat)
    act = cc.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    pred = cc.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("n_pred"))
    tp = cc.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"), F.col("count").alias("tp"))
    t = act.join(pred, "label", "full").join(tp, "label", "left").fillna(0, ["support", "n_pred", "tp"])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return t.select("label", F.col("support").cast("long").alias("support"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def accuracy_f1(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Accuracy and support-weighted F1."""
    pc = per_class(df, y, yhat)
    return pc.agg((F.sum(F.col("support") * F.col("recall")) / F.sum("support")).alias("accuracy"),
                  (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1_weighted"))


def _score_counts(df: DataFrame, y: str, score: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    t = df.select(*by, (q(y).cast("string") == F.lit(str(positive))).alias("pos"), q(score).cast("double").alias("s")) \
        .where(F.col("s").isNotNull() & F.col("pos").isNotNull())
    return t.groupBy(*by, "s").agg(F.sum(F.col("pos").cast("long")).alias("np"),
                              F.sum((~F.col("pos")).cast("long")).alias("nn"))


def roc_auc(df: DataFrame, y: str, score: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """Binary ROC-AUC with ties counted ½: rank-sum form over distinct scores;
    one row, or one per group of the ``by`` columns."""
    sc = _score_counts(df, y, score, positive, by).withColumn("cnt", F.col("np") + F.col("nn"))
    pos = value_positions(sc, "s", by=by, weight="cnt").select(*by, "s", "avg_rank")
    j = sc.join(pos, [*by, "s"])
    st = j.groupBy(*by).agg(F.sum("np").alias("P"), F.sum("nn").alias("N"), F.sum(F.col("np") * F.col("avg_rank")).alias("R"))
    pp, nn = F.col("P").cast("double"), F.col("N").cast("double")
    return st.select(*by, F.when((pp > 0) & (nn > 0), (F.col("R") - pp * (pp + 1) / 2) / (pp * nn)).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y: str, score_cols: dict[str, str]) -> DataFrame:
    """Multiclass one-vs-rest macro AUC: mean of per-class binary AUCs."""
    out = None
    for label, col in score_cols.items():
        a = roc_auc(df, y, col, label).select(F.lit(str(label)).alias("label"), "roc_auc")
        out = a if out is None else out.unionByName(a)
    return out.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def average_precision(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """Σ (ΔRecall) · Precision over distinct thresholds, step-wise (not trapezoid)."""
    sc = _score_counts(df, y, score, positive).withColumn("neg_s", -F.col("s"))
    above_p = value_positions(sc, "neg_s", weight="np").select("neg_s", F.col("before").alias("tp_above"))
    above_n = value_positions(sc, "neg_s", weight="nn").select("neg_s", F.col("before").alias("fp_above"))
    j = sc.join(above_p, "neg_s").join(above_n, "neg_s")
    tp = F.col("tp_above") + F.col("np")
    fp = F.col("fp_above") + F.col("nn")
    tot = j.agg(F.sum("np").alias("P")).first()["P"] or 0
    return j.agg((F.sum(F.when(F.col("np") > 0, F.col("np") * tp / (tp + fp)).otherwise(0.0)) / F.lit(float(tot) or 1.0))
                 .alias("average_precision"))


def log_loss(df: DataFrame, y: str, proba: str, positive=1) -> DataFrame:
    """Binary log loss with probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(q(proba).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    is_pos = q(y).cast("string") == F.lit(str(positive))
    t = df.where(q(y).isNotNull() & q(proba).isNotNull())
    return t.agg(F.avg(-F.when(is_pos, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def classification_metrics(df: DataFrame, y: str, yhat: str, proba: str | None = None, positive=1) -> DataFrame:
    """Accuracy, weighted F1 and, with a score column, ROC-AUC, log loss and AP."""
    out = accuracy_f1(df, y, yhat)
    if proba is None:
        return out
    auc = roc_auc(df, y, proba, positive).first()["roc_auc"]
    ll = log_loss(df, y, proba, positive).first()["log_loss"]
    ap = average_precision(df, y, proba, positive).first()["average_precision"]
    return out.select("*", F.lit(auc).cast("double").alias("roc_auc"), F.lit(ll).cast("double").alias("log_loss"),
                      F.lit(ap).cast("double").alias("average_precision"))


# ------------------------------------------------------------- residuals (152, 153)

def residual_stats(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """mean, sd (pop), min, max, median, population skew, IQR, q5/25/75/95,
    corr(residual, prediction); requires n >= 3 finite pairs."""
    t = _pairs(df, y, yhat).select((F.col("y") - F.col("p")).alias("r"), "p")
    qs = column_quantiles(t, {"r": F.col("r")}, [0.05, 0.25, 0.5, 0.75, 0.95])["r"]
    st = t.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_residual"), F.stddev_pop("r").alias("std_residual"),
               F.min("r").alias("min_residual"), F.max("r").alias("max_residual"),
               F.lit(qs).cast("array<double>").alias("qs") if qs[0] is not None
               else F.lit(None).cast("array<double>").alias("qs"),
               F.skewness("r").alias("skew"), F.corr("r", "p").alias("rc"))
    return st.where(F.col("n") >= 3).select(
        F.col("n").cast("long").alias("n"), "mean_residual", "std_residual", "min_residual", "max_residual",
        F.col("qs")[2].alias("median_residual"), F.coalesce("skew", F.lit(0.0)).alias("skew"),
        (F.col("qs")[3] - F.col("qs")[1]).alias("iqr"), F.col("qs")[0].alias("q5"), F.col("qs")[1].alias("q25"),
        F.col("qs")[3].alias("q75"), F.col("qs")[4].alias("q95"),
        F.coalesce(F.col("rc"), F.lit(0.0)).alias("residual_vs_predicted_corr"))


def pred_vs_actual(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """correlation, max over/under-prediction and mean error (one row)."""
    t = _pairs(df, y, yhat)
    err = F.col("p") - F.col("y")
    return t.agg(F.coalesce(F.corr("y", "p"), F.lit(0.0)).alias("correlation"), F.max(err).alias("max_overprediction"),
                 F.min(err).alias("max_underprediction"), F.avg(err).alias("mean_error"))


def bias_by_quintile(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean (prediction - actual) per quintile of the actual values; bins
    [lo, hi) with the top edge nudged up by 1e-9; empty bins report 0."""
    t = _pairs(df, y, yhat)
    e = column_quantiles(t, {"y": F.col("y")}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])["y"]
    e[-1] += 1e-9
    rows = []
    for i in range(5):
        cond = (F.col("y") >= F.lit(e[i])) & (F.col("y") < F.lit(e[i + 1]))
        rows.append(F.struct(F.lit(i).alias("quintile"), F.lit(e[i]).alias("lo"), F.lit(e[i + 1]).alias("hi"),
                             F.count(F.when(cond, 1)).alias("n"),
                             F.coalesce(F.avg(F.when(cond, F.col("p") - F.col("y"))), F.lit(0.0)).alias("bias")))
    return t.agg(F.array(*rows).alias("a")).select(F.inline("a"))


# --------------------------------------------------------------- confusion (154)

def top_confusions(df: DataFrame, y: str, yhat: str, k: int = 5) -> DataFrame:
    """Off-diagonal cells ordered by (count, actual, predicted) descending."""
    cc = confusion_counts(df, y, yhat)
    return (cc.where(F.col("actual") != F.col("predicted"))
            .orderBy(F.desc("count"), F.desc("actual"), F.desc("predicted")).limit(k))


# ----------------------------------------------------------- Bland-Altman (155)

def bland_altman(df: DataFrame, a: str, b: str) -> DataFrame:
    """mean difference, sd (pop), limits of agreement, n and share outside."""
    d = df.select((q(a).cast("double") - q(b).cast("double")).alias("d")).dropna()
    st = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).first()
    if st["n"] < 2 or not st["s"]:
        return df.sparkSession.createDataFrame(
            [], "mean_diff double, std_diff double, loa_low double, loa_high double, width_loa double, "
                "n long, n_outside_loa long, pct_outside_loa double")
    lo, hi = st["m"] - 1.96 * st["s"], st["m"] + 1.96 * st["s"]
    out = d.agg(F.sum(((F.col("d") < lo) | (F.col("d") > hi)).cast("long")).alias("k"))
    return out.select(F.lit(st["m"]).alias("mean_diff"), F.lit(st["s"]).alias("std_diff"), F.lit(lo).alias("loa_low"),
                      F.lit(hi).alias("loa_high"), F.lit(hi - lo).alias("width_loa"),
                      F.lit(st["n"]).cast("long").alias("n"), F.col("k").cast("long").alias("n_outside_loa"),
                      (F.col("k") / F.lit(st["n"])).alias("pct_outside_loa"))


# ---------------------------------------------------- model comparisons (156-158)

def paired_cv_comparison(fold_scores: DataFrame, model: str = "model", fold: str = "fold",
                         score: str = "score") -> DataFrame:
    """For each model pair (a < b) sharing folds: mean of (b - a) fold
    differences and a paired t (Shapiro p >= .05) or Wilcoxon test.  The fold
    table is small (models x folds)."""
    a = fold_scores.select(F.col(model).alias("model_a"), F.col(fold).alias("fold"), F.col(score).alias("sa"))
    b = fold_scores.select(F.col(model).alias("model_b"), F.col(fold).alias("fold"), F.col(score).alias("sb"))
    pairs = a.join(b, "fold").where(F.col("model_a") < F.col("model_b"))
    out = []
    for r in pairs.select("model_a", "model_b").distinct().collect():
        sub = pairs.where((F.col("model_a") == r["model_a"]) & (F.col("model_b") == r["model_b"]))
        diffs = [x["d"] for x in sub.select((F.col("sb") - F.col("sa")).alias("d")).collect()]  # one per fold
        from cohortspark.functions import dist
        normal = len(diffs) >= 3 and dist.shapiro_wilk(diffs)[1] >= 0.05
        res = htest.paired_test(sub, "sa", "sb", parametric=normal).first()
        out.append((r["model_a"], r["model_b"], len(diffs), sum(diffs) / len(diffs), res["test"],
                    res["statistic"], res["p_value"]))
    return fold_scores.sparkSession.createDataFrame(
        out, "model_a string, model_b string, n_folds long, mean_diff double, test string, statistic double, "
             "p_value double")


def importance_rank_agreement(imp: DataFrame, model: str = "model", feature: str = "feature",
                              importance: str = "importance", top_k: int = 5) -> DataFrame:
    """Spearman correlation of importance ranks and top-k overlap per model pair,
    over the features both models use.  The (model, feature) table is small."""
    w = Window.partitionBy(model).orderBy(F.desc(importance), F.asc(feature))
    ranked = imp.select(F.col(model).alias("m"), F.col(feature).alias("f"), F.col(importance).alias("v"),
                        F.row_number().over(w).alias("pos"))
    wr = Window.partitionBy("m", "v")
    ranked = ranked.withColumn("avg_rank", F.min("pos").over(wr) + (F.count(F.lit(1)).over(wr) - 1) / 2.0) \
        .withColumn("top", F.col("pos") <= top_k)
    a = ranked.select(F.col("m").alias("model_a"), "f", F.col("avg_rank").alias("ra"), F.col("top").alias("ta"))
    b = ranked.select(F.col("m").alias("model_b"), "f", F.col("avg_rank").alias("rb"), F.col("top").alias("tb"))
    j = a.join(b, "f").where(F.col("model_a") < F.col("model_b"))
    return j.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_shared"), F.corr("ra", "rb").alias("spearman"),
        F.sum((F.col("ta") & F.col("tb")).cast("long")).alias("top_k_overlap"))


def comparison_table(baselines: DataFrame, models: DataFrame, dp: int = 4) -> DataFrame:
    """Baselines first, then models, with 'estimate [lo, hi]' text per metric."""
    fmt = f"%.{dp}f [%.{dp}f, %.{dp}f]"

    def prep(d, kind, order):
        return d.select("name", "metric", "estimate", "ci_lower", "ci_upper", F.lit(kind).alias("kind"),
                        F.lit(order).alias("kind_order"),
                        F.format_string(fmt, "estimate", "ci_lower", "ci_upper").alias("text"))
    return prep(baselines, "baseline", 0).unionByName(prep(models, "model", 1))
