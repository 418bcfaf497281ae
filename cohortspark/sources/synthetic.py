"""Built-in synthetic datasets (ops 6-8), generated on executors.

Each row's random numbers are keyed hashes of (seed, row id, stream), so the
data are identical for any partitioning; ``spark.range`` spreads the rows.
These are demonstration inputs for examples and tests -- registered
computations always read real tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.split import uniform


def _normal(seed: int, stream: int) -> Column:
    """Standard normal via Box-Muller from two keyed uniforms."""
    u1 = F.greatest(uniform(seed, F.col("id"), F.lit(stream)), F.lit(1e-300))
    u2 = uniform(seed, F.col("id"), F.lit(stream + 1000))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def linear_with_outliers(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """y = 2 x1 + 1.5 x2 + N(0, .5); 10 % of rows get an extra N(0, 10)."""
    base = spark.range(n)
    x1, x2 = _normal(seed, 1), _normal(seed, 2)
    noise = _normal(seed, 3) * 0.5
    contaminated = uniform(seed, F.col("id"), F.lit(4)) < 0.1
    extra = F.when(contaminated, _normal(seed, 5) * 10).otherwise(0.0)
    return base.select(x1.alias("feature_1"), x2.alias("feature_2"), "id") \
        .select("id", "feature_1", "feature_2",
                (2 * F.col("feature_1") + 1.5 * F.col("feature_2") + noise + extra).alias("target"))


def nonlinear_regression(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """y = sin(x1) · x2² + x3 + N(0, .3)."""
    base = spark.range(n)
    return base.select("id", _normal(seed, 1).alias("feature_1"), _normal(seed, 2).alias("feature_2"),
                       _normal(seed, 3).alias("feature_3")) \
        .withColumn("target", F.sin("feature_1") * F.col("feature_2") ** 2 + F.col("feature_3")
                    + _normal(seed, 4) * 0.3)


def imbalanced_classification(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """y = 1 iff x1 > .5 and x2 > .3, with 10 % of labels flipped."""
    base = spark.range(n).select("id", _normal(seed, 1).alias("feature_1"), _normal(seed, 2).alias("feature_2"),
                                 _normal(seed, 3).alias("feature_3"))
    y = ((F.col("feature_1") > 0.5) & (F.col("feature_2") > 0.3)).cast("int")
    flip = uniform(seed, F.col("id"), F.lit(4)) < 0.1
    return base.withColumn("target", F.when(flip, 1 - y).otherwise(y))


# Built-in dataset names.
BUILTIN = {
    "linear_with_outliers": linear_with_outliers,
    "nonlinear_regression": nonlinear_regression,
    "imbalanced_classification": imbalanced_classification,
}
