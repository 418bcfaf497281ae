"""Distributed ranks, positions and Kendall's discordance count.

``Window.orderBy`` without a partition collapses to one task, so it is never
used on row-scale data.  Instead:

1. count rows per distinct value (map-side combined);
2. range-partition the value counts by (group, value), as many ranges as the
   session has shuffle partitions, and write them with their range;
3. totals per (group, range) give each range's offset;
4. a running sum inside each range (``Window.partitionBy(group, range)``).

Average rank of value v = rows before v + (count(v) + 1) / 2 -- the pandas /
SciPy "average" method.  Ties come for free as Σ(t³ - t).

Ranks go back to rows by a join on the value that splits hot values: values
with more than one row in HOT are broadcast (at most HOT of them), the others
are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import q
from cohortspark.session import written


def _bucket_expr(x: Column, cuts: Sequence[float]) -> Column:
    """Index of the bucket holding x, given ascending cut points."""
    if not cuts:
        return F.lit(0)
    arr = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(arr, lambda c: c < x.cast("double"))).cast("int")


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None,
                    buckets: int | None = None) -> DataFrame:
    """Per distinct (by..., value): count and number of rows strictly before it.

    Output columns: *by, value, cnt, before, avg_rank.  ``by`` groups are
    ranked independently (the offsets are per (group, range)).
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counts = (df.where(q(value).isNotNull()).groupBy(*[q(b) for b in by], q(value).alias("__v"))
              .agg(F.sum(w).cast("long").alias("cnt")))
    keys = [q(b) for b in by]
    ranges = ([buckets] if buckets else []) + [*keys, F.col("__v")]
    placed = written(counts.repartitionByRange(*ranges).withColumn("__b", F.spark_partition_id()), "value-counts")
    # a row per (group, range) that occurs: groups + ranges at most, as groups lie one after the other
    totals = placed.groupBy(*keys, "__b").agg(F.sum("cnt").alias("t"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[q(b).alias(f"__g{i}") for i, b in enumerate(by)], F.col("__b").alias("__r"),
                            F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("__off"))
    same = F.col("__b") == F.col("__r")
    for i, b in enumerate(by):
        same = same & q(b).eqNullSafe(F.col(f"__g{i}"))
    run = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum("cnt").over(run), F.lit(0)) + F.col("__off")).cast("long")
    return (placed.join(offsets, same).select(*keys, F.col("__v").alias(value), "cnt", before.alias("before"))
            .withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0))


HOT = 4096


def attach(rows: DataFrame, positions: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Inner join of rows to value_positions() on ``on``, with the columns ``cols`` of the positions.  No value's rows
    meet in one task if it holds more than one row in HOT: those values, at most HOT, are broadcast."""
    on = list(on)
    positions = written(positions.select(*on, *dict.fromkeys(["cnt", *cols])), "positions")
    total = positions.agg(F.sum("cnt")).first()[0] or 0
    hot, rest = (positions.where(cond).select(*on, *cols) for cond in (
        F.col("cnt") * HOT > total, F.col("cnt") * HOT <= total))
    return (rows.join(F.broadcast(hot), on)
            .unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on)))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of the columns (complete ones) with their count ``c`` and the average rank of each column
    (``r_`` and its name)."""
    cols = list(cols)
    cells = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("c"))
    cells = written(cells, "rank-cells")
    out = cells
    for c in cols:
        pos = value_positions(cells, c, weight="c").withColumnRenamed("avg_rank", f"r_{c}")
        out = attach(out, pos, [c], [f"r_{c}"])
    return out


def average_rank(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Attach the average rank of ``value`` (within ``by`` groups) to every row."""
    pos = value_positions(df, value, by).withColumnRenamed("avg_rank", out)
    ranked = attach(df.where(q(value).isNotNull()), pos, [*by, value], [out])
    return ranked.unionByName(df.where(q(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def tie_term(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Σ(t³ - t) over tie groups of ``value`` (per ``by`` group)."""
    vc = df.where(q(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"))
    return vc.groupBy(*by).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))


# ------------------------------------------------------------------ Kendall

def _local_discordant(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted discordant pairs inside one x-bucket: pairs with x_i < x_j and
    y_i > y_j, each cell weighted by its count (merge-free Fenwick count)."""
    if pdf.empty:
        return pd.DataFrame({"__b": [], "d": []})
    pdf = pdf.sort_values(["x", "yr"])
    ys = pdf["yr"].to_numpy()
    cs = pdf["c"].to_numpy().astype(np.int64)
    xs = pdf["x"].to_numpy()
    size = int(ys.max()) + 2
    tree = np.zeros(size + 1, dtype=np.int64)
    total = 0
    d = 0
    i = 0
    n = len(xs)
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:
            j += 1
        # query all cells with this x against strictly smaller x already inserted
        for k in range(i, j):
            # count inserted with y-rank > ys[k]
            s, idx = 0, int(ys[k]) + 1
            while idx > 0:
                s += tree[idx]
                idx -= idx & (-idx)
            d += cs[k] * (total - s)
        for k in range(i, j):
            idx = int(ys[k]) + 1
            while idx <= size:
                tree[idx] += cs[k]
                idx += idx & (-idx)
            total += cs[k]
        i = j
    return pd.DataFrame({"__b": [int(pdf["__b"].iloc[0])], "d": [int(d)]})


def kendall_counts(df: DataFrame, x: str, y: str, buckets: int = 32) -> dict:
    """n, discordant pairs and tie sums for Kendall's tau-b on complete pairs.

    Works on distinct (x, y) cells with counts; x is cut into range buckets.
    Discordant pairs inside a bucket: a Fenwick count per bucket
    (``applyInPandas`` over that bucket's distinct cells).  Across buckets:
    every cell needs the number of rows in earlier buckets with a larger
    y-rank; that is a suffix sum over y-ranks of the per-bucket histograms,
    computed with the same bucketed prefix-offset scheme as ranks.  No pair is
    ever materialised and no window spans the whole table.
    """
    pairs = df.select(q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).dropna()
    cells = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    # dense y-rank: number of distinct y values below
    ypos = value_positions(cells.select("y").distinct(), "y")
    cells = cells.join(ypos.select("y", F.col("before").alias("yr")), "y")
    cut_row = cells.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 1000)
                        .alias("c")).first()
    cuts = sorted(set(cut_row["c"] or []))
    nb = len(cuts) + 1
    cells = cells.withColumn("__b", _bucket_expr(F.col("x"), cuts))
    local = (cells.groupBy("__b").applyInPandas(_local_discordant, "__b int, d long")
             .agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))).first()["d"]
    hist = cells.groupBy("__b", "yr").agg(F.sum("c").alias("c"))
    cross = _cross_bucket(hist, nb)
    n = pairs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    tx = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("t"))
    ty = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("t"))
    txy = cells.select(F.col("c").alias("t"))

    def tsum(t):
        tt = F.col("t").cast("double")
        return t.agg(F.coalesce(F.sum(tt * (tt - 1) / 2), F.lit(0.0)).alias("a"),
                     F.coalesce(F.sum(tt * (tt - 1) * (tt - 2)), F.lit(0.0)).alias("b"),
                     F.coalesce(F.sum(tt * (tt - 1) * (2 * tt + 5)), F.lit(0.0)).alias("c")).first()
    sx, sy, sxy = tsum(tx), tsum(ty), tsum(txy)
    return {"n": n, "discordant": int(local or 0) + int(cross),
            "xtie": sx["a"], "x0": sx["b"], "x1": sx["c"],
            "ytie": sy["a"], "y0": sy["b"], "y1": sy["c"], "ntie": sxy["a"]}


def _cross_bucket(hist: DataFrame, nb: int, ybuckets: int = 64) -> int:
    """Σ over cells (b, yr, c) of c * #{rows in buckets < b with y-rank > yr}."""
    bcols = [f"b{b}" for b in range(nb)]
    wide = (hist.groupBy("yr").pivot("__b", list(range(nb))).agg(F.sum("c"))
            .select("yr", *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).cast("long").alias(f"b{b}")
                            for b in range(nb)]))
    cut_row = wide.agg(F.percentile_approx("yr", [i / ybuckets for i in range(1, ybuckets)], 1000)
                       .alias("c")).first()
    cuts = sorted(set(cut_row["c"] or []))
    wide = wide.withColumn("__yb", _bucket_expr(F.col("yr"), cuts))
    tot = wide.groupBy("__yb").agg(*[F.sum(c).alias(c) for c in bcols]).collect()
    tot = sorted(tot, key=lambda r: r["__yb"])
    # suffix offsets: rows of yr-ranges strictly above this one, per x-bucket
    offs, acc = {}, [0] * nb
    for r in reversed(tot):
        offs[r["__yb"]] = list(acc)
        acc = [a + (r[c] or 0) for a, c in zip(acc, bcols)]
    w = Window.partitionBy("__yb").orderBy(F.desc("yr")).rowsBetween(Window.unboundedPreceding, -1)
    suff = []
    for j, c in enumerate(bcols):
        om = F.create_map(*[v for yb, o in offs.items() for v in (F.lit(yb), F.lit(o[j]))])
        suff.append((F.coalesce(F.sum(c).over(w), F.lit(0)) + om[F.col("__yb")]).cast("long"))
    above = wide.select("yr", F.array(*suff).alias("above"))
    q_ = hist.join(above, "yr")
    earlier = F.aggregate(F.slice("above", 1, F.col("__b")), F.lit(0).cast("long"), lambda a, v: a + v)
    res = q_.agg(F.coalesce(F.sum(F.col("c") * earlier), F.lit(0)).alias("d")).first()["d"]
    return int(res)
