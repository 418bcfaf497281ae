"""Fused per-column aggregation: many columns, many statistics, one scan.

The pattern used across the engine: build every statistic for every column as
one wide ``agg`` (one scan, map-side partial aggregation, a single tiny
shuffle), then unpivot the one-row result into a long table keyed by column.
Nothing row-sized ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import q

StatFn = Callable[[Column], Column]

APPROX_ACCURACY = 100_000


def approx_quantile_expr(c: Column, probs: Sequence[float]) -> Column:
    """Quantiles of the GK sketch: actual values, bounded memory, one pass."""
    return F.percentile_approx(c.cast("double"), F.array(*[F.lit(float(p)) for p in probs]), APPROX_ACCURACY)


def wide_agg(df: DataFrame, cols: Sequence[str], stats: dict[str, StatFn],
             extra: Iterable[Column] = ()) -> DataFrame:
    """One-row DataFrame with ``{i}__{stat}`` for every column index i."""
    exprs = [fn(q(c)).alias(f"c{i}__{name}")
             for i, c in enumerate(cols) for name, fn in stats.items()]
    exprs.extend(extra)
    return df.agg(*exprs)


def unpivot_stats(row: DataFrame, cols: Sequence[str], stats: Sequence[str],
                  key: str = "column", keep: Sequence[str] = ()) -> DataFrame:
    """Turn the ``wide_agg`` row into one row per column (lazy, no collect)."""
    structs = [
        F.struct(F.lit(c).alias(key), *[F.col(f"c{i}__{s}").alias(s) for s in stats],
                 *[F.col(k).alias(k) for k in keep])
        for i, c in enumerate(cols)
    ]
    if not structs:
        raise ValueError("no columns to summarise")
    return row.select(F.inline(F.array(*structs)))


def per_column(df: DataFrame, cols: Sequence[str], stats: dict[str, StatFn],
               key: str = "column") -> DataFrame:
    """Long table (column, stat1, stat2, ...) from one scan of ``df``."""
    return unpivot_stats(wide_agg(df, cols, stats), cols, list(stats), key=key)


def collect_scalars(df: DataFrame, cols: Sequence[str], stats: dict[str, StatFn]) -> dict:
    """Driver dict {column: {stat: value}} -- O(columns x stats) values only."""
    row = wide_agg(df, cols, stats).first()
    return {c: {s: row[f"c{i}__{s}"] for s in stats} for i, c in enumerate(cols)}


def scalar_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     method: str = "exact") -> dict[str, list[float | None]]:
    """Driver dict column -> quantiles.  ``exact``: linear-interpolated, by
    selection with bounded memory (``functions/quantiles.py``); ``approx``: GK
    sketch, one pass."""
    cols = list(cols)
    if not cols:
        return {}
    if method in ("exact", "select"):
        from cohortspark.functions.quantiles import exact_quantiles
        return exact_quantiles(df, cols, probs)
    row = df.agg(*[approx_quantile_expr(q(c), probs).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}


def by_column(values: dict[str, object], kind: str = "double", key: str = "column") -> Column:
    """The value of the row's column name: small per-column results as one literal map."""
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(kind))])[F.col(key)]


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Column -> exact number of distinct values (NULL is none), all columns in one scan.

    Each cell becomes one narrow row (column number, value in the field of its
    type); distinct cells are combined before the shuffle and then counted per
    column.  Several exact distinct counts in one ``agg`` would expand every
    row to all columns' width once per column.
    """
    cols = list(cols)
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for i, c in enumerate(cols):
        name, x = types[c].typeName(), q(c)
        whole = name in ("byte", "short", "integer", "long", "boolean", "date", "timestamp", "timestamp_ntz")
        if name in ("date", "timestamp", "timestamp_ntz"):
            x = F.unix_date(x) if name == "date" else F.unix_micros(x.cast("timestamp"))
        real = name in ("float", "double")
        text = x if name == "string" else x.cast("string") if name not in ("binary", "array", "map", "struct") \
            else F.hex(x) if name == "binary" else F.to_json(F.struct(x))
        cells.append(F.when(q(c).isNotNull(), F.struct(
            F.lit(i).alias("i"), (x if whole else F.lit(None)).cast("long").alias("l"),
            (x if real else F.lit(None)).cast("double").alias("d"),
            (F.lit(None) if whole or real else text).cast("string").alias("s"))))
    found = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*").distinct()
             .groupBy("i").agg(F.count(F.lit(1)).alias("u")).collect())
    counts = {r["i"]: r["u"] for r in found}
    return {c: counts.get(i, 0) for i, c in enumerate(cols)}


def sum_partials(partials, add: Callable):
    """RDD of (key, partial result of a task) -> RDD of (key, total), in two
    steps: groups of tasks first, so that no reducer gets one record of every
    task even where all tasks share one key."""
    n = partials.getNumPartitions()
    fan = max(int(n ** 0.5), 1)
    if fan > 2:
        grouped = partials.mapPartitionsWithIndex(lambda i, rows: (((k, i % fan), v) for k, v in rows))
        partials = grouped.reduceByKey(add).map(lambda kv: (kv[0][0], kv[1]))
    return partials.reduceByKey(add)


def reduce_partials(partials, add: Callable) -> dict:
    """``sum_partials`` as a dict on the driver."""
    return dict(sum_partials(partials, add).collect())
