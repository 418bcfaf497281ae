"""Spark-native tabular audit, statistics and modelling engine.

Every operator takes DataFrames and returns DataFrames (or a handful of
driver-side scalars: per column, per group, per replicate).  Row-scale work
always stays on executors.
"""

from cohortspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
