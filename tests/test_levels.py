"""Encoders with more levels than fit a literal map, with a hot level, missing and unknown values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import preprocess as pp


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 9000
    many = np.where(rng.random(n) < 0.35, "hot", np.char.add("l", rng.integers(0, 3000, n).astype(str)))
    pdf = pd.DataFrame({"id": np.arange(n), "many": many, "few": rng.choice(["a", "b", "c"], n), "y": rng.normal(size=n)})
    pdf.loc[::40, "many"] = None
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, many string, few string, y double").repartition(5)


def test_ordinal_and_label(spark, df, frame):
    order = {v: float(i) for i, v in enumerate(sorted(frame["many"].dropna().unique()))}
    fitted = pp.fit_ordinal(df, ["many", "few"])
    assert "many" not in fitted.levels and fitted.levels["few"] == ["a", "b", "c"]
    got = fitted.transform(df).toPandas().set_index("id")
    assert got.columns.tolist() == ["many", "few", "y"]
    assert got["many"].to_dict() == {i: order.get(v, -1.0) for i, v in zip(frame["id"], frame["many"])}
    new = spark.createDataFrame([(1, "unseen", "z", 0.0), (2, None, None, 0.0), (3, "hot", "b", 0.0)], df.schema)
    assert [(r.id, r.many, r.few) for r in fitted.transform(new).orderBy("id").collect()] == [
        (1, -1.0, -1.0), (2, -1.0, -1.0), (3, order["hot"], 1.0)]
    lab = pp.fit_label_encoder(df, "many").transform(df).toPandas().set_index("id")["many"]
    assert {i: None if pd.isna(v) else int(v) for i, v in lab.items()} == {
        i: None if v is None else int(order[v]) for i, v in zip(frame["id"], frame["many"].where(frame["many"].notna(), None))}


def test_one_hot_is_sparse_for_many_levels(df, frame):
    levels = sorted(frame["many"].dropna().unique())
    fitted = pp.fit_one_hot(df, ["many", "few"])
    out = fitted.transform(df)
    assert out.columns == ["id", "y", "few_a", "few_b", "few_c", "many_levels"] == ["id", "y", *fitted.output_names()]
    for r in out.where("id < 200").collect():
        v = frame["many"][r.id]
        assert r.many_levels.size == len(levels)
        assert r.many_levels.indices.tolist() == ([levels.index(v)] if isinstance(v, str) else [])


def test_target_encoder(df, frame):
    enc, train = pp.fit_target_encoder(df, ["many"], "y", key=["id"])
    assert enc.table is not None and not enc.maps
    assert train.count() == len(frame) and train.columns == df.columns
    prior, var = frame["y"].mean(), frame["y"].var(ddof=0)
    g = frame.groupby("many")["y"].agg(["sum", "count", lambda v: (v ** 2).sum()])
    g.columns = ["s", "n", "s2"]
    mean = g.s / g.n
    lam = g.n * var / (g.n * var + np.maximum(g.s2 / g.n - mean ** 2, 0))
    want = (lam * mean + (1 - lam) * prior).to_dict()
    got = enc.transform(df).toPandas().set_index("id")["many"]
    for i, v in zip(frame["id"], frame["many"]):
        assert got[i] == pytest.approx(want.get(v, prior), rel=1e-9)


def test_rows_of_a_hot_level_do_not_meet(df):
    table = pp.fit_ordinal(df, ["many"]).table
    is_hot = F.col("cnt") * pp.HOT > table.totals["many"]
    assert table.table.where(is_hot).where("level = 'hot'").count() == 1
    assert table.table.where(is_hot).count() <= pp.HOT
    plan = table.lookup(df, "many", F.lit(-1.0))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "broadcast" in plan


def test_streams(spark, df, frame, tmp_path):
    fitted = pp.fit_ordinal(df, ["many"])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (fitted.transform(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(frame) and got.exceptAll(fitted.transform(df)).count() == 0
