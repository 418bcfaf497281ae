"""Top-k per group without funnelling a whole group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    k: int, salt_on: Sequence[str] | None = None,
                    buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order``.

    Two stages: first the top k inside (group, hash-bucket) slices -- each
    group is spread over ``buckets`` tasks, so a hot group cannot land in a
    single task -- then the final top k over at most k*buckets candidates per
    group.  Exact: the global top k is contained in the union of slice top ks.
    """
    group_cols = list(group_cols)
    salt_src = [F.col(c) for c in (salt_on or [c for c in df.columns if c not in group_cols])]
    salted = df.withColumn("__b", F.pmod(F.xxhash64(*salt_src), F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "__b").orderBy(*order)
    stage1 = salted.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (stage1.drop("__r", "__b")
            .withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k))
