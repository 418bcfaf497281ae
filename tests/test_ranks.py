"""Ranks by range partitions and hot values that do not meet in one task, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortspark.operators import htest, ranks


def hot_frame(n=6000):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n).round(2))
    return pd.DataFrame({"x": x, "y": rng.normal(size=n) + 0.3 * x, "g": rng.integers(0, 3, n).astype(str)})


def test_positions_and_average_ranks(spark):
    pdf = hot_frame()
    pdf.loc[::50, "x"] = np.nan
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, y double, g string").repartition(7)
    got = ranks.average_rank(df, "x", "rank", by=["g"]).toPandas().sort_values(["g", "y"])
    want = pdf.assign(rank=pdf.groupby("g")["x"].rank()).sort_values(["g", "y"])
    np.testing.assert_allclose(got["rank"], want["rank"])
    pos = ranks.value_positions(df, "x").toPandas().sort_values("x")
    counts = pdf["x"].value_counts().sort_index()
    assert pos["x"].tolist() == counts.index.tolist() and pos["cnt"].tolist() == counts.tolist()
    assert pos["before"].tolist() == (counts.cumsum() - counts).tolist()


def test_spearman_with_a_value_on_most_rows(spark):
    pdf = hot_frame()
    got = htest.spearman_stats(spark.createDataFrame(pdf), "x", "y").first()
    assert got["n"] == len(pdf)
    assert abs(got["r"] - np.corrcoef(pdf["x"].rank(), pdf["y"].rank())[0, 1]) < 1e-12


def test_hot_values_are_broadcast_and_the_rest_is_even(spark):
    df = spark.createDataFrame(hot_frame()).repartition(8)
    pos = ranks.value_positions(df, "x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ranks.attach(df, pos, ["x"], ["avg_rank"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("BroadcastHashJoin") >= 2
        total = 6000
        hot = pos.where(F.col("cnt") * ranks.HOT > total)
        # what goes through the shuffle has no value above one row in HOT, so its largest task stays near the others
        rest = df.join(hot, "x", "left_anti").groupBy("x").count().agg(F.max("count")).first()[0] or 0
        assert rest * ranks.HOT <= total
        assert plan.count() == total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty(spark):
    df = spark.createDataFrame([], "x double, g string")
    assert ranks.value_positions(df, "x", by=["g"]).count() == 0
    assert ranks.average_rank(df, "x").count() == 0
