"""Shared helpers for registered computations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cohortspark.functions.columns import normalize_missing, round_doubles
from cohortspark.sources.io import balance_partitions, load_parquet

DP = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalize_missing(balance_partitions(load_parquet(spark, f"{sf_dir}/{name}.parquet")))


def rounded(df: DataFrame, dp: int = DP) -> DataFrame:
    """Round doubles for cross-engine comparison: first to a 12-digit decimal
    (absorbs summation-order noise), then to ``dp`` digits in decimal
    arithmetic, so a value on a rounding tie rounds the same way in both
    engines."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            dec = F.expr(f"try_cast(`{f.name}` AS DECIMAL(38, 12))")
            out.append(F.round(dec, dp).cast("double").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r(expr: str, dp: int = DP) -> str:
    """SQL twin of ``rounded``: decimal(38, 12) first, then ``dp`` digits."""
    return f"CAST(round(TRY_CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38, 12)), {dp}) AS DOUBLE)"


def rcol(c, dp: int = DP):
    """Column twin of ``r`` for a single value."""
    from pyspark.sql import functions as F
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double").cast("decimal(38, 12)"), dp).cast("double")
