"""Join diagnostics: key overlap, hot-key report and data-driven key
suggestions (ops 33, 35)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import q


def key_overlap(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Number of distinct non-null key values present in both tables."""
    rk = right_key or key
    a = left.select(q(key).alias("k")).where(F.col("k").isNotNull())
    b = right.select(q(rk).alias("k")).where(F.col("k").isNotNull())
    return a.intersect(b).agg(F.count(F.lit(1)).alias("overlap"))


def hot_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Most frequent key values (NULL included) -- what would skew a join."""
    return (df.groupBy(q(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc_nulls_first("key")).limit(k))


# Name-score patterns.
_ENTITY_WORDS = ("patient", "user", "customer", "account", "order", "product")
_TIME_WORDS = ("date", "time", "timestamp")
_KEY_NAMES = ("id", "key", "index", "code")


def name_score(col: str) -> float:
    low = col.lower()
    s = 0
    if "id" in low:
        s += 3
    if low.endswith("key"):
        s += 2
    if low in _KEY_NAMES:
        s += 2
    if any(w in low for w in _ENTITY_WORDS):
        s += 1
    if any(w in low for w in _TIME_WORDS):
        s += 1
    return min(s, 5) / 5.0


def _key_stats(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(q(col).alias("k")).agg(F.count(F.lit(1)).alias("c"))


def suggest_join_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For every column shared by a pair of tables: the name score plus what the
    data says -- overlap of distinct keys, uniqueness on each side, null
    share and expected rows of the inner join relative to the left table.

    Per candidate one groupBy per side (key -> count) and one join of those
    count tables; output is one row per candidate.
    """
    names = list(tables)
    rows = None
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            shared = [c for c in tables[a].columns if c in set(tables[b].columns)]
            for c in shared:
                ka = _key_stats(tables[a], c).withColumnRenamed("c", "ca")
                kb = _key_stats(tables[b], c).withColumnRenamed("c", "cb")
                # key-count tables are O(distinct keys); one full join + one agg
                fo = ka.alias("x").join(kb.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")), "full")
                key = F.coalesce(F.col("x.k"), F.col("y.k"))
                both = F.col("ca").isNotNull() & F.col("cb").isNotNull() & key.isNotNull()
                st = fo.agg(
                    F.coalesce(F.sum("ca"), F.lit(0)).alias("n_left"),
                    F.coalesce(F.sum("cb"), F.lit(0)).alias("n_right"),
                    F.coalesce(F.sum(F.when(key.isNull(), F.col("ca"))), F.lit(0)).alias("null_left"),
                    F.coalesce(F.sum(F.when(key.isNull(), F.col("cb"))), F.lit(0)).alias("null_right"),
                    F.count(F.when(key.isNotNull(), F.col("ca"))).alias("distinct_left"),
                    F.count(F.when(key.isNotNull(), F.col("cb"))).alias("distinct_right"),
                    F.count(F.when(both, F.lit(1))).alias("overlap"),
                    F.coalesce(F.sum(F.when(both, F.col("ca") * F.col("cb"))), F.lit(0)).alias("joined_rows"))
                one = st.select(
                    F.lit(a).alias("left_table"), F.lit(b).alias("right_table"),
                    F.lit(c).alias("column"), F.lit(name_score(c)).alias("name_score"),
                    F.col("overlap").cast("long").alias("overlap"),
                    (F.col("distinct_left") / (F.col("n_left") - F.col("null_left"))).alias("unique_left"),
                    (F.col("distinct_right") / (F.col("n_right") - F.col("null_right"))).alias("unique_right"),
                    ((F.col("null_left") + F.col("null_right")) /
                     (F.col("n_left") + F.col("n_right"))).alias("null_share"),
                    (F.col("joined_rows") / F.col("n_left")).alias("row_multiplier"))
                rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no shared columns")
    return rows
