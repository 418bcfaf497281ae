"""Apply fitted transforms and models to a stream.

The fitted preprocessing steps (units, plausibility gate, imputation, power
transforms, capping, scaling, encoders) are per-row Column expressions, so
the same objects run unchanged on a Structured Streaming DataFrame.  The
sink is ``foreachBatch`` into Parquet (idempotent per batch id) with a
checkpoint under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortspark.session import checkpoint_dir


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, file_glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder as a stream (schema required)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def transform_stream(stream: DataFrame, fitted) -> DataFrame:
    """Run a fitted step / pipeline / model on a streaming DataFrame."""
    return fitted.transform(stream)


def write_parquet_batches(stream: DataFrame, path: str, name: str, trigger_once: bool = True):
    """foreachBatch sink: each micro-batch appended to ``path/batch_id=<id>``
    (overwrite of the same batch id on retry keeps the output exactly-once)."""
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
