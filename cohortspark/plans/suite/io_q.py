"""Source / sink computations (ops 2-5, 9-14) and the streaming adapter.

Each round trip writes a table derived from the driver tables to a fresh
folder under the shared checkpoint location and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import models as md
from cohortspark.operators import preprocess as pp
from cohortspark.plans.suite import register
from cohortspark.plans.suite.common import r, rounded, table
from cohortspark.sources import io
from cohortspark.streaming import apply as st

_ORD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                            "o_orderpriority")


def _typed(df):
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
                     F.col("o_totalprice").cast("double"), "o_orderpriority")


@register("io_csv_roundtrip", _ORD)
def q_csv(spark, sf):
    path = io.scratch_path(spark, "orders_csv")
    io.save_csv(_orders(spark, sf), path)
    return _typed(io.load_csv(spark, path))


@register("io_tsv_roundtrip", _ORD)
def q_tsv(spark, sf):
    path = io.scratch_path(spark, "orders") + ".tsv"
    _orders(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return _typed(io.load_table(spark, path))


@register("io_csv_latin1_fallback", """
SELECT n_nationkey, n_name || 'é' AS n_name FROM nation
""")
def q_latin1(spark, sf):
    path = io.scratch_path(spark, "nation_latin1")
    n = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("é")).alias("n_name"))
    n.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = io.load_csv(spark, path)
    return back.select(F.col("n_nationkey").cast("int"), "n_name")


@register("io_parquet_sink_roundtrip", _ORD)
def q_parquet(spark, sf):
    path = io.scratch_path(spark, "orders_parquet")
    io.save_parquet(_orders(spark, sf), path, partition_by=["o_orderstatus"])
    return io.load_table(spark, path, fmt="parquet").select(*_orders(spark, sf).columns)


@register("io_transpose_long", """
SELECT n_name, "column", value FROM (UNPIVOT (SELECT n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey,
  CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation) ON n_nationkey, n_regionkey INTO NAME "column" VALUE value)
""")
def q_transpose_long(spark, sf):
    return io.transpose_long(table(spark, sf, "nation"), "n_name")


@register("io_transpose")
def q_transpose(spark, sf):
    return io.transpose_table(table(spark, sf, "region"), "r_name")


@register("io_fingerprint")
def q_fingerprint(spark, sf):
    return io.fingerprint(table(spark, sf, "lineitem"))


@register("io_prediction_export")
def q_export(spark, sf):
    li = table(spark, sf, "lineitem")
    m = md.fit_ols(li, ["l_quantity"], "l_extendedprice")
    path = io.scratch_path(spark, "predictions")
    io.export_predictions(m.transform(li.withColumn("row_key", F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice"))),
                          path, "row_key", "l_extendedprice")
    return io.load_csv(spark, path)


@register("io_model_save_load", f"""
SELECT l_orderkey, l_linenumber, {r("regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity", 4)} AS prediction
FROM lineitem
""")
def q_model_io(spark, sf):
    li = table(spark, sf, "lineitem")
    m = md.fit_ols(li, ["l_quantity"], "l_extendedprice")
    path = io.scratch_path(spark, "model")
    io.save_model(m, path)
    back = io.load_model(path)
    return rounded(back.transform(li).select("l_orderkey", "l_linenumber", "prediction"), 4)


@register("stream_apply_scaler", f"""
SELECT event_id, {r("(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)")} AS value FROM events
""")
def q_stream(spark, sf):
    batch = table(spark, sf, "events")
    scaler = pp.fit_scaler(batch, ["value"], "standard")
    stream = st.read_stream(spark, sf, batch.schema, file_glob="events.parquet")
    out = io.scratch_path(spark, "stream_out")
    q = st.write_parquet_batches(st.transform_stream(stream.select("event_id", "value"), scaler), out,
                                 name=out.rsplit("/", 1)[-1])
    q.awaitTermination()
    return rounded(spark.read.parquet(out).select("event_id", "value"))
