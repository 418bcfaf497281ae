"""Exact linear-interpolated quantiles and modes for every column and group, in bounded memory.

Spark's exact ``percentile`` and ``mode`` keep a value -> count map of a whole
column (and group) in one buffer.  Selection needs none.  Without groups, or
with up to DRIVER_GROUPS of them:

1. one scan gives count, minimum and maximum per (group, column);
2. each bracket that still holds several values is cut into cells, half of them
   of equal width and half equal in the order of the doubles; one scan counts,
   for all columns, groups and probabilities at once, rows, least and largest
   value per cell (Arrow batches sorted in numpy, one record per task and cell
   that is not empty).  The work of a row does not depend on the number of
   probabilities.  Where few brackets are open only their rows are read;
3. the cell of an order statistic is its next bracket, until it holds one value:
   three or four scans on smooth data, 22 at most on any.

With more groups:

1. one scan with the GK sketch per (group, column) gives count, minimum,
   maximum and, for each probability, a bracket: the sketch's values 4/ACCURACY
   to either side.  The sketch is off by at most 1/ACCURACY of the rows, so for
   more than SMALL rows the bracket holds the wanted order statistics; smaller
   groups take [minimum, maximum];
2. one scan counts, for all open brackets of all columns and groups at once,
   the rows below and inside and takes the least value above;
3. brackets that still hold more than BAND rows are cut by an equal-width
   histogram to the bin of the order statistic and counted again (a hot value
   fills a bracket of its own and is never moved);
4. the rows inside the last brackets, some thousandths of all, are counted per
   value, and a running sum per bracket picks the order statistic and the next.

The passes read the projected values from memory as far as they fit there
(MEMORY_ONLY: what does not is read again, nothing is spilled for it); they are
released at the end.  The brackets of many groups are a table with a row per
group, joined to the rows by broadcast up to BROADCAST_BYTES and by a shuffle
beyond.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from cohortspark.functions.columns import q
from cohortspark.session import written

ACCURACY = 1000
SMALL = 1000
BAND = 100_000
BINS = 4096
ROUNDS = 40
DRIVER_GROUPS = 1000
BROADCAST_BYTES = 64 << 20
CELLS = 1 << 14       # in one scan, over all open brackets (8 a bracket at least)
FEW = 24              # brackets whose rows alone are read
BAND_LIMIT = 1 << 18  # rows that a task sorts at once


def _number(x) -> str:
    """A SQL literal of the same value."""
    if x is None:
        return "NULL"
    if isinstance(x, int):
        return str(x)
    return f"{x!r}D".upper() if math.isfinite(x) else f"double('{x}')"


class _Plan:
    """The passes over the rows, for values v[i] (columns __v0, __v1, ...) and probabilities p[j]; target t = i *
    len(p) + j.  ``at(name, t)`` gives a target's field (n: of the value) as SQL, a field of the joined state or a
    literal.  Expressions are SQL text: one call to the JVM each, where building them bit by bit takes thousands."""

    def __init__(self, values: int, probs: list[float]):
        self.values, self.probs = values, probs
        self.v = [f"__v{i}" for i in range(values) for _ in probs]  # by target
        self.targets = range(len(self.v))
        self.around = [x for p in probs for x in (max(0.0, p - 4.0 / ACCURACY), min(1.0, p + 4.0 / ACCURACY))]

    def sketch(self) -> list[Column]:
        around = ", ".join(map(_number, self.around))
        return [F.expr(f"struct(count({x}) AS n, min({x}) AS mn, max({x}) AS mx, "
                       f"percentile_approx({x}, array({around}), {ACCURACY}) AS s)").alias(f"a{i}")
                for i, x in enumerate(f"__v{i}" for i in range(self.values))]

    def start(self) -> list[Column]:
        """n (per value), k (rank of the lower order statistic), lo and hi (per target) from the sketch."""
        per = len(self.probs)

        def edge(t, side):
            a, e = f"a{t // per}", 2 * (t % per) + side
            sure = "true" if self.around[e] in (0.0, 1.0) else f"{a}.n <= {SMALL}"
            return f"if({sure}, {a}.{'mx' if side else 'mn'}, get({a}.s, {e}))"

        fields = {"n": [f"a{i}.n" for i in range(self.values)],
                  "k": [f"bigint(floor((a{t // per}.n - 1) * {_number(self.probs[t % per])}))" for t in self.targets],
                  "lo": [edge(t, 0) for t in self.targets], "hi": [edge(t, 1) for t in self.targets]}
        return [F.expr(f"array({', '.join(v)})").alias(name) for name, v in fields.items()]

    def inside(self, at, t: int) -> str:
        return f"{self.v[t]} >= {at('lo', t)} AND {self.v[t]} <= {at('hi', t)}"

    def counts(self, at) -> list[Column]:
        below = [f"count(if({self.v[t]} < {at('lo', t)}, 1, NULL))" for t in self.targets]
        within = [f"count(if({self.inside(at, t)}, 1, NULL))" for t in self.targets]
        above = [f"min(if({self.v[t]} > {at('hi', t)}, {self.v[t]}, NULL))" for t in self.targets]
        return [F.expr(f"array({', '.join(c)})").alias(name)
                for name, c in (("below", below), ("within", within), ("above", above))]

    def _tagged(self, rows: DataFrame, keys: list[str], at, targets, more: str, fields: str) -> DataFrame:
        """A row for each target whose open bracket holds the value: t, x, k (rank within the bracket)."""
        tags = [f"if({self.inside(at, t)} AND {at('lo', t)} < {at('hi', t)}{more.format(within=at('within', t))}, "
                f"struct({t} AS t, {self.v[t]} AS x, {at('k', t)} - {at('below', t)} AS k"
                f"{fields.format(lo=at('lo', t), hi=at('hi', t))}), NULL)" for t in targets]
        return rows.selectExpr(*keys, f"explode(array_compact(array({', '.join(tags)}))) AS e").select(*keys, "e.*")

    def narrower(self, rows: DataFrame, keys: list[str], at, targets) -> DataFrame:
        """*keys, t, lo, hi: brackets cut to the histogram bin of their order statistic."""
        tagged = self._tagged(rows, keys, at, targets, f" AND {{within}} > {BAND}", ", {lo} AS lo, {hi} AS hi")
        # halves, so that the width of the widest range does not overflow
        place = F.expr(f"least(floor((x / 2 - lo / 2) / ((hi / 2 - lo / 2) / {BINS})), {BINS - 1})")
        bins = tagged.groupBy(*keys, "t", place.alias("bin")).agg(
            F.expr("count(1) AS c"), F.expr("min(x) AS mn"), F.expr("max(x) AS mx"), F.expr("any_value(k) AS k"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "t").orderBy("bin"))
        return bins.select(*keys, "t", "mn", "mx", "k", upto.alias("upto")).groupBy(*keys, "t").agg(
            F.expr("min(if(upto > k, mn, NULL)) AS lo"), F.expr("min(if(upto > k, mx, NULL)) AS hi"))

    def picked(self, rows: DataFrame, keys: list[str], at, targets) -> DataFrame:
        """*keys, t, v0, v1: the order statistic and the next one (null if that is above the bracket) for brackets
        with more than one value."""
        cells = self._tagged(rows, keys, at, targets, "", "").groupBy(*keys, "t", "x").agg(
            F.expr("count(1) AS c"), F.expr("any_value(k) AS k"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "t").orderBy("x"))
        return cells.select(*keys, "t", "x", "k", upto.alias("upto")).groupBy(*keys, "t").agg(
            F.expr("min(if(upto > k, x, NULL)) AS v0"), F.expr("min(if(upto > k + 1, x, NULL)) AS v1"))


def _order(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order (one zero; NaN is largest, as in Spark)."""
    b = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b)


def _double(key: int) -> float:
    b = np.array([key], dtype=np.int64)
    return float(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64)[0])


def _edges(lo: int, hi: int, cells: int) -> np.ndarray:
    """Edges that cut the keys lo..hi: lo, hi and what follows it, equal steps of the keys and of the values."""
    a, b = _double(lo), _double(hi)
    steps = np.array([lo + (hi - lo) * i // cells for i in range(cells + 1)], dtype=np.int64)
    if math.isfinite(a) and math.isfinite(b):
        even = _order(np.linspace(a / 2, b / 2, cells + 1) * 2)
        steps = np.concatenate([steps, even[(even > lo) & (even < hi)]])
    return np.unique(np.append(steps, min(hi + 1, np.iinfo(np.int64).max)))


def _cells(edges: dict, values: int):
    """Per task, (group, value) and cell that is not empty: rows, least and largest key.  Cell j is [edge j-1, edge j)."""
    kinds = pa.schema([("g", pa.int32()), ("i", pa.int32()), ("cell", pa.int32()),
                       ("c", pa.int64()), ("mn", pa.int64()), ("mx", pa.int64())])

    def fn(batches):
        acc: dict = {}
        held: list = [[] for _ in range(values)]
        rows = 0

        def flush():
            for i in range(values):
                if not held[i]:
                    continue
                g, x = (np.concatenate(part) for part in zip(*held[i]))
                held[i].clear()
                order = np.argsort(g, kind="stable")
                groups, first = np.unique(g[order], return_index=True)
                for name, part in zip(groups.tolist(), np.split(order, first[1:])):
                    e = edges.get((name, i))
                    if e is None:
                        continue
                    keys = np.sort(_order(x[part]))
                    at = np.concatenate(([0], np.searchsorted(keys, e, "left"), [len(keys)]))
                    c = np.diff(at)
                    nz = np.flatnonzero(c)
                    if (name, i) not in acc:
                        acc[(name, i)] = (np.zeros(len(e) + 1, np.int64), np.full(len(e) + 1, np.iinfo(np.int64).max),
                                          np.full(len(e) + 1, np.iinfo(np.int64).min))
                    n, mn, mx = acc[(name, i)]
                    n[nz] += c[nz]
                    mn[nz] = np.minimum(mn[nz], keys[at[nz]])
                    mx[nz] = np.maximum(mx[nz], keys[at[nz + 1] - 1])

        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(values):
                col = batch.column(1 + i)
                there = col.is_valid().to_numpy(zero_copy_only=False) if col.null_count else slice(None)
                held[i].append((g[there], col.to_numpy(zero_copy_only=False)[there]))
            rows += batch.num_rows
            if rows >= BAND_LIMIT:
                flush()
                rows = 0
        flush()
        for (name, i), (n, mn, mx) in acc.items():
            nz = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nz), v, np.int32)) for v in (name, i)] + [
                pa.array(nz.astype(np.int32)), pa.array(n[nz]), pa.array(mn[nz]), pa.array(mx[nz])], schema=kinds)
    return fn


def _extent(values: int) -> list[Column]:
    return [c for i in range(values) for c in (F.expr(f"count(__v{i}) AS n{i}"), F.expr(f"min(__v{i}) AS mn{i}"),
                                               F.expr(f"max(__v{i}) AS mx{i}"))]


def _selected(rows: DataFrame, extents: list, values: int, probs: list[float]) -> dict[tuple[int, int], tuple[int, list[float] | None]]:
    """(group, value) -> (n, quantiles) over rows (__g, __v0, ...); ``extents``: a row of n, mn, mx per group."""
    found, low, rank, base, above = {}, {}, {}, {}, {}  # base: rows below a bracket, above: the least key above it
    for g, r in enumerate(extents):
        for i in range(values):
            for j, p in enumerate(probs if r[f"n{i}"] else ()):
                low[(g, i, j)] = tuple(_order(np.array([r[f"mn{i}"], r[f"mx{i}"]], dtype=float)).tolist())
                rank[(g, i, j)] = math.floor((r[f"n{i}"] - 1) * p)
                base[(g, i, j)], above[(g, i, j)] = 0, low[(g, i, j)][1]
    for t, (lo, hi) in list(low.items()):
        if lo == hi:
            found[t] = (lo, lo)
            del low[t]
    while low:
        brackets = {(g, i, *b) for (g, i, _j), b in low.items()}
        each = max(4, CELLS // (2 * len(brackets)))
        cut: dict = {}
        for g, i, lo, hi in brackets:
            cut.setdefault((g, i), []).append(_edges(lo, hi, each))
        edges = {at: np.unique(np.concatenate(e)) for at, e in cut.items()}
        near = rows
        if len(brackets) <= FEW:  # rows outside of all brackets are known already
            near = rows.where(" OR ".join(f"__v{i} BETWEEN {_number(_double(lo))} AND {_number(_double(hi))}"
                                          for i, lo, hi in {b[1:] for b in brackets}))
        parts = near.mapInArrow(_cells(edges, values), "g int, i int, cell int, c long, mn long, mx long")
        cells = parts.groupBy("g", "i", "cell").agg(F.sum("c").alias("c"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
        table: dict = {}
        for r in sorted(cells.collect()):
            table.setdefault((r["g"], r["i"]), []).append((r["c"], r["mn"], r["mx"]))
        sums = {at: tuple(np.array(c, dtype=np.int64) for c in zip(*t)) for at, t in table.items()}
        upto = {at: np.cumsum(c) for at, (c, _mn, _mx) in sums.items()}
        for t in list(low):
            c, mn, mx = sums[t[:2]]
            first, end = np.searchsorted(mn, low[t][0], "left"), np.searchsorted(mx, low[t][1], "right")
            within = upto[t[:2]][first:end] - (upto[t[:2]][first] - c[first]) + base[t]
            at = int(np.searchsorted(within, rank[t], "right"))
            after = int(mn[first + at + 1]) if first + at + 1 < end else above[t]
            lo, hi = int(mn[first + at]), int(mx[first + at])
            if lo < hi:
                low[t], base[t], above[t] = (lo, hi), int(within[at] - c[first + at]), after
                continue
            found[t] = (lo, lo if within[at] > rank[t] + 1 else after)
            del low[t]
    out = {}
    for g, r in enumerate(extents):
        for i in range(values):
            n = r[f"n{i}"]
            vals = []
            for j, p in enumerate(probs if n else ()):
                v0, v1 = map(_double, found[(g, i, j)])
                share = (n - 1) * p - rank[(g, i, j)]
                vals.append(v0 + share * (v1 - v0) if share > 0 else v0)
            out[(g, i)] = (n, vals if n else None)
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(b[k])
    return same


def _with(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, _same(a, b, keys), how).drop(*[b[k] for k in keys])


def _settled(state: DataFrame) -> tuple[DataFrame, int]:
    """A table with a row per group, computed once, and its number of rows: up to DRIVER_GROUPS rows are kept as a
    local table, more are written."""
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    n = state.count()
    if n <= DRIVER_GROUPS:
        out = state.sparkSession.createDataFrame(state.collect(), state.schema)
    else:
        out = written(state, "quantile-groups")
    state.unpersist()
    return out, n


def group_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float],
                    by: Mapping[str, Column]) -> DataFrame:
    """One row per (group, column): *by, column, n, q (array of the quantiles,
    pandas / DuckDB ``quantile_cont`` semantics; null where n = 0).

    ``values``: column name -> numeric expression; ``by``: key name -> expression
    (null is a group of its own).  NULL values are ignored.
    """
    probs, names = [float(p) for p in probs], list(values)
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[c.alias(k) for k, c in zip(keys, by.values())],
                     *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(values.values())])
    rows = rows.persist(StorageLevel.MEMORY_ONLY)
    seen, groups = _settled(rows.groupBy(*keys).agg(*_extent(len(names))))
    if groups <= DRIVER_GROUPS:
        extents = seen.collect()
        index = df.sparkSession.createDataFrame([(*[r[k] for k in keys], g) for g, r in enumerate(extents)],
                                                T.StructType([*[rows.schema[k] for k in keys], T.StructField("__g", T.IntegerType())]))
        placed = _with(rows, F.broadcast(index), keys).select("__g", *[f"__v{i}" for i in range(len(names))])
        found = _selected(placed, extents, len(names), probs)
        rows.unpersist()
        return df.sparkSession.createDataFrame(
            [(*[r[k] for k in keys], c, *found[(g, i)]) for g, r in enumerate(extents) for i, c in enumerate(names)],
            T.StructType([*[T.StructField(name, rows.schema[k].dataType) for k, name in zip(keys, by)],
                          T.StructField("column", T.StringType()), T.StructField("n", T.LongType()),
                          T.StructField("q", T.ArrayType(T.DoubleType()))]))
    plan = _Plan(len(names), probs)
    per, every = len(probs), plan.targets
    state, groups = _settled(rows.groupBy(*keys).agg(*plan.sketch()).select(*keys, *plan.start()))
    small = groups * (len(names) + 6 * len(every)) * 8 <= BROADCAST_BYTES

    def at(name, t):
        return f"get({name}, {t if name != 'n' else t // per})"

    def side(table):
        return F.broadcast(table) if small else table

    for _ in range(ROUNDS):
        counts = _with(rows, side(state), keys).groupBy(*keys).agg(*plan.counts(at))
        state, _ = _settled(_with(state, side(counts), keys))
        full = f"exists(arrays_zip(lo, hi, within), x -> x.within > {BAND} AND x.lo < x.hi)"
        if state.where(full).isEmpty():
            break
        cut = plan.narrower(_with(rows, side(state), keys), keys, at, every).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("t", F.struct("lo", "hi")))).alias("cut"))
        state, _ = _settled(_with(state, side(cut), keys, "left").selectExpr(*keys, "n", "k", *[
            f"array({', '.join(f'coalesce(try_element_at(cut, {t}).{f}, {at(f, t)})' for t in every)}) AS {f}"
            for f in ("lo", "hi")]))
    else:
        raise RuntimeError("quantile brackets did not close")
    found = (plan.picked(_with(rows, side(state), keys), keys, at, every).groupBy(*keys)
             .agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("v0", "v1")))).alias("found")))
    done, _ = _settled(_with(state, side(found), keys, "left"))
    rows.unpersist()

    def value(t: int) -> str:
        one = f"if({at('lo', t)} = {at('hi', t)} AND {at('below', t)} + {at('within', t)} > {at('k', t)} + 1, {at('lo', t)}, NULL)"
        v0 = f"coalesce(try_element_at(found, {t}).v0, {at('lo', t)})"
        v1 = f"coalesce(try_element_at(found, {t}).v1, {one}, {at('above', t)})"
        share = f"(({at('n', t)} - 1) * {_number(probs[t % per])} - {at('k', t)})"
        return f"if({share} > 0, {v0} + {share} * ({v1} - {v0}), {v0})"

    parts = [f"struct({i} AS i, {at('n', i * per)} AS n, if({at('n', i * per)} > 0, "
             f"array({', '.join(value(i * per + j) for j in range(per))}), NULL) AS q)" for i in range(len(names))]
    named = F.get(F.array(*map(F.lit, names)), F.col("i"))
    out = done.selectExpr(*keys, f"inline(array({', '.join(parts)}))").select(*keys, named.alias("column"), "n", "q")
    return out.select(*[F.col(k).alias(name) for k, name in zip(keys, by)], "column", "n", "q")


def column_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Name -> quantiles of an expression over all rows (driver scalars), NULLs ignored."""
    if not values:
        return {}
    rows = df.select(F.lit(0).alias("__g"), *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(values.values())])
    rows = rows.persist(StorageLevel.MEMORY_ONLY)
    found = _selected(rows, [rows.agg(*_extent(len(values))).first()], len(values), [float(p) for p in probs])
    rows.unpersist()
    return {c: found[(0, i)][1] or [None] * len(probs) for i, c in enumerate(values)}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Column -> quantiles of the whole column (driver scalars), NULLs ignored."""
    return column_quantiles(df, {c: q(c) for c in cols}, probs)


def modes(df: DataFrame, values: Mapping[str, Column]) -> dict[str, object]:
    """Name -> most frequent value (the smallest among ties; None without values): counts per value with map-side
    sums, one small query a column in one job, then the best of each; no map of a column in one buffer."""
    if not values:
        return {}
    best = None
    for i, x in enumerate(values.values()):
        counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        one = counts.agg(F.min_by("v", F.struct((-F.col("c")).alias("c"), "v")).alias("v"))
        one = one.withColumnRenamed("v", f"m{i}")
        best = one if best is None else best.unionByName(one, allowMissingColumns=True)
    rows = best.collect()
    return {c: next((r[f"m{i}"] for r in rows if r[f"m{i}"] is not None), None) for i, c in enumerate(values)}
