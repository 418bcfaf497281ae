"""Preprocessing transforms fitted on a training DataFrame and applied anywhere
(ops 105-118c).

A fitted step holds only small parameters (per column, per level) and applies
as Column expressions, so ``transform`` works unchanged on a batch or a
streaming DataFrame and stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import scalar_quantiles
from cohortspark.functions.columns import q
from cohortspark.functions.quantiles import column_quantiles, modes
from cohortspark.operators.gram import gram, total
from cohortspark.operators.ranks import HOT, attach, value_positions
from cohortspark.session import cut_lineage, written


class Fitted:
    """Base: a fitted transform is a function DataFrame -> DataFrame."""

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def _replace(self, df: DataFrame, exprs: Mapping[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
        return df.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns], *extra)


# ---------------------------------------------------------------- numeric impute (105, 107)

@dataclass
class NumericImputer(Fitted):
    fill: dict[str, float]
    indicators: list[str] = field(default_factory=list)

    def transform(self, df):
        ind = [q(c).isNull().cast("double").alias(f"missingindicator_{c}") for c in self.indicators]
        return self._replace(df, {c: F.coalesce(q(c).cast("double"), F.lit(v)) for c, v in self.fill.items()}, ind)


def fit_numeric_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "median",
                        add_indicator: bool = False, fill_value: float = 0.0,
                        quantile_method: str = "exact") -> NumericImputer:
    """mean / median (exact) / constant; indicators for columns missing at fit."""
    cols = list(cols)
    meds = scalar_quantiles(df, cols, [0.5], quantile_method) if strategy == "median" else {}
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        if strategy == "mean":
            exprs.append(F.avg(x).alias(f"f{i}"))
        elif strategy == "median":
            exprs.append(F.lit(meds[c][0]).cast("double").alias(f"f{i}"))
        else:
            exprs.append(F.lit(float(fill_value)).alias(f"f{i}"))
        exprs.append(F.sum(x.isNull().cast("long")).alias(f"m{i}"))
    row = df.agg(*exprs).first()
    fill = {c: (row[f"f{i}"] if row[f"f{i}"] is not None else float("nan")) for i, c in enumerate(cols)}
    ind = [c for i, c in enumerate(cols) if add_indicator and (row[f"m{i}"] or 0) > 0]
    return NumericImputer(fill, ind)


# ------------------------------------------------------------- iterative impute (106)

@dataclass
class IterativeImputer(Fitted):
    cols: list[str]
    init: dict[str, float]
    rounds: list[dict[str, tuple[float, list[float]]]]  # per round: col -> (a, b over others)

    def _refilled(self, state: Column, missing: Column, rounds) -> Column:
        """``state`` (array of values, in the order of cols) after the given
        rounds.  One fold over the steps, a step being one column of one
        round, so the expression grows with the number of coefficients only."""
        at = {c: i for i, c in enumerate(self.cols)}
        steps = [(at[c], *rnd[c]) for rnd in rounds for c in self.cols if c in rnd]
        if not steps:
            return state
        lits = [F.struct(F.lit(j).alias("j"), F.lit(float(a)).alias("a"),
                         F.array(*[F.lit(float(v)) for v in [*b[:j], 0.0, *b[j:]]]).alias("b")) for j, a, b in steps]

        def step(acc, s):
            terms = F.transform(acc, lambda v, i: F.when(i == s["j"], 0.0).otherwise(v * F.get(s["b"], i)))
            pred = F.aggregate(terms, s["a"], lambda x, t: x + t)
            return F.transform(acc, lambda v, i: F.when((i == s["j"]) & F.get(missing, i), pred).otherwise(v))

        return F.aggregate(F.array(*lits), state, step)

    def transform(self, df):
        x = [q(c).cast("double") for c in self.cols]
        state = F.array(*[F.coalesce(v, F.lit(self.init[c])) for c, v in zip(self.cols, x)])
        done = df.withColumn("__imputed", self._refilled(state, F.array(*[v.isNull() for v in x]), self.rounds))
        return self._replace(done, {c: F.get("__imputed", F.lit(i)) for i, c in enumerate(self.cols)}).drop("__imputed")


def fit_iterative_imputer(df: DataFrame, cols: Sequence[str], max_iter: int = 10, alpha: float = 1e-6,
                          tol: float = 1e-3, checkpoint_every: int = 3) -> IterativeImputer:
    """Chained equations: each round regresses every incomplete column on the
    others (ridge, from one Gram pass keyed by missingness pattern) and
    refills its missing cells; rows' filled values feed the next round.
    Lineage is cut with a reliable checkpoint every few rounds."""
    cols = list(cols)
    init = fit_numeric_imputer(df, cols, "mean").fill
    miss = {c: f"__miss_{i}" for i, c in enumerate(cols)}
    base = df.select(*[q(c).cast("double").alias(c) for c in cols],
                     *[q(c).isNull().alias(miss[c]) for c in cols])
    some = base.agg(*[F.max(F.col(miss[c])).alias(miss[c]) for c in cols]).first()
    incomplete = [c for c in cols if some[miss[c]]]
    model = IterativeImputer(cols, init, [])
    cur = base.select(*[F.coalesce(F.col(c), F.lit(init[c])).alias(c) for c in cols],
                      *[F.col(miss[c]) for c in cols])
    pattern = F.concat_ws("", *[F.col(miss[c]).cast("int").cast("string") for c in cols])
    prev = None
    for it in range(max_iter):
        g = gram(cur.withColumn("__pat", pattern), cols, by=["__pat"])
        rnd = {}
        for j, c in enumerate(cols):
            if c not in incomplete:
                continue
            obs = [gg for k, gg in g.items() if k[j] == "0"]
            if not obs:
                continue
            gj = total({str(i): v for i, v in enumerate(obs)})
            others = [o for o in cols if o != c]
            ix = gj.index(others)
            iy = gj.index([c])[0]
            sxx = gj.scatter[np.ix_(ix, ix)] + alpha * np.eye(len(ix))
            b = np.linalg.lstsq(sxx, gj.scatter[ix, iy], rcond=None)[0] if ix else np.array([])
            a = float(gj.mean[iy] - (gj.mean[ix] @ b if ix else 0.0))
            rnd[c] = (a, [float(v) for v in b])
        model.rounds.append(rnd)
        # refill: sequential within the round, as chained equations do
        missing = F.array(*[F.col(miss[c]) for c in cols])
        new = model._refilled(F.array(*[q(c) for c in cols]), missing, [rnd])
        cur = (cur.select(new.alias("__state"), *[F.col(miss[c]) for c in cols])
               .select(*[F.get("__state", F.lit(i)).alias(c) for i, c in enumerate(cols)], *[F.col(miss[c]) for c in cols]))
        if (it + 1) % checkpoint_every == 0:
            cur = cut_lineage(cur)
        flat = np.array([v for c in sorted(rnd) for v in [rnd[c][0], *rnd[c][1]]])
        if prev is not None and flat.shape == prev.shape and np.max(np.abs(flat - prev)) < tol:
            break
        prev = flat
    return model


# ------------------------------------------------------------ power transforms (108, 109)

@dataclass
class Log1p(Fitted):
    cols: list[str]

    def transform(self, df):
        return self._replace(df, {c: F.log1p(F.greatest(q(c).cast("double"), F.lit(0.0))) for c in self.cols})


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        p = F.log1p(x)
    else:
        p = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        n = -F.log1p(-x)
    else:
        n = -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x.isNull(), None).when(pos, p).otherwise(n)


@dataclass
class YeoJohnson(Fitted):
    lambdas: dict[str, float]

    def transform(self, df):
        return self._replace(df, {c: yeo_johnson_expr(q(c).cast("double"), l) for c, l in self.lambdas.items()})


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], lo: float = -4.0, hi: float = 4.0,
                    grid: int = 41, passes: int = 4) -> YeoJohnson:
    """λ maximising the Yeo-Johnson profile log-likelihood, all columns at once.

    Each pass is one aggregation evaluating Σt and Σt² for every (column, λ)
    on a grid; the grid then zooms in around each column's best λ.
    llf(λ) = -n/2 log(var_pop(t_λ)) + (λ - 1) Σ sign(x) log1p(|x|).
    """
    cols = list(cols)
    sl = df.agg(*[F.sum(F.signum(q(c)) * F.log1p(F.abs(q(c).cast("double")))).alias(f"s{i}") for i, c in enumerate(cols)],
                *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    bounds = {c: (lo, hi) for c in cols}
    best = {c: 1.0 for c in cols}
    for _ in range(passes):
        lams = {c: list(np.linspace(bounds[c][0], bounds[c][1], grid)) for c in cols}
        exprs = []
        for i, c in enumerate(cols):
            x = q(c).cast("double")
            for j, lam in enumerate(lams[c]):
                t = yeo_johnson_expr(x, float(lam))
                exprs += [F.sum(t).alias(f"a{i}_{j}"), F.sum(t * t).alias(f"b{i}_{j}")]
        row = df.agg(*exprs).first()
        for i, c in enumerate(cols):
            n = sl[f"n{i}"]
            if not n:
                continue
            lls = []
            for j, lam in enumerate(lams[c]):
                s1, s2 = row[f"a{i}_{j}"], row[f"b{i}_{j}"]
                var = s2 / n - (s1 / n) ** 2 if s1 is not None else float("nan")
                ll = -n / 2 * math.log(var) + (lam - 1) * sl[f"s{i}"] if var and var > 0 and math.isfinite(var) \
                    else -math.inf
                lls.append(ll)
            k = int(np.argmax(lls))
            best[c] = float(lams[c][k])
            step = (bounds[c][1] - bounds[c][0]) / (grid - 1)
            bounds[c] = (best[c] - step, best[c] + step)
    return YeoJohnson(best)


# ----------------------------------------------------------------- capping (110)

@dataclass
class Clip(Fitted):
    bounds: dict[str, tuple[float, float]]

    def transform(self, df):
        return self._replace(df, {c: F.least(F.greatest(q(c).cast("double"), F.lit(lo)), F.lit(hi))
                                  for c, (lo, hi) in self.bounds.items()})


def fit_outlier_capping(df: DataFrame, cols: Sequence[str], method: str = "percentile",
                        params: Mapping | None = None) -> Clip:
    """Clip at fit-time q01/q99 (linear quantiles) or median ± t·1.4826·MAD."""
    params = dict(params or {})
    cols = list(cols)
    if method == "mad":
        thr = float(params.get("threshold", 3.5))
        med = {c: v[0] for c, v in scalar_quantiles(df, cols, [0.5]).items()}
        mad = column_quantiles(df, {c: F.abs(q(c).cast("double") - F.lit(m)) for c, m in med.items() if m is not None}, [0.5])
        return Clip({c: (med[c] - thr * 1.4826 * d[0], med[c] + thr * 1.4826 * d[0]) for c, d in mad.items()})
    lo_q, hi_q = float(params.get("lower_q", 0.01)), float(params.get("upper_q", 0.99))
    qs = scalar_quantiles(df, cols, [lo_q, hi_q], params.get("quantile_method", "exact"))
    return Clip({c: (qs[c][0], qs[c][1]) for c in cols if qs[c][0] is not None})


# ------------------------------------------------------------------ scalers (111-113)

@dataclass
class Affine(Fitted):
    """(x - shift) / scale per column."""
    params: dict[str, tuple[float, float]]

    def transform(self, df):
        return self._replace(df, {c: (q(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in self.params.items()})


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> Affine:
    """standard: mean / population sd (0 -> 1); robust: median / IQR (0 -> 1);
    minmax: min / range (0 -> 1)."""
    cols = list(cols)
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        if kind == "standard":
            exprs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        else:
            exprs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"m{i}")]
    quart = scalar_quantiles(df, cols, [0.25, 0.5, 0.75]) if kind == "robust" else {}
    row = df.agg(*exprs).first() if kind != "robust" else None
    out = {}
    for i, c in enumerate(cols):
        if kind == "standard":
            a, b = row[f"a{i}"], row[f"b{i}"]
        elif kind == "robust":
            lo, a, hi = quart[c]
            b = hi - lo if a is not None else None
        else:
            a, b = row[f"a{i}"], (row[f"m{i}"] - row[f"a{i}"]) if row[f"a{i}"] is not None else None
        if b is None or b == 0 or (isinstance(b, float) and math.isnan(b)):
            b = 1.0
        out[c] = (float(a) if a is not None else 0.0, float(b))
    return Affine(out)


# ------------------------------------------------------------ categorical (114-118)

@dataclass
class CategoricalImputer(Fitted):
    fill: dict[str, str]

    def transform(self, df):
        return self._replace(df, {c: F.coalesce(q(c).cast("string"), F.lit(v)) for c, v in self.fill.items()})


def fit_categorical_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "most_frequent") -> CategoricalImputer:
    """Most frequent level (smallest on ties) or the constant 'missing'."""
    cols = list(cols)
    if strategy != "most_frequent":
        return CategoricalImputer({c: "missing" for c in cols})
    common = modes(df, {c: q(c).cast("string") for c in cols})
    return CategoricalImputer({c: "missing" if v is None else v for c, v in common.items()})


INLINE_LEVELS = 1000


@dataclass
class LevelTable:
    """Levels of columns with many of them, as a table: column, level, cnt (rows at fit time), value.  It is joined to
    the rows; levels with more than one row in ranks.HOT are broadcast, so that their rows do not meet in one task."""
    table: DataFrame
    totals: dict[str, int]
    sizes: dict[str, int] = field(default_factory=dict)

    def lookup(self, df: DataFrame, col: str, default: Column) -> DataFrame:
        """``df`` with ``col`` replaced by its level's value, ``default`` where the level is missing or unknown."""
        own = self.table.where(F.col("column") == col)
        is_hot = F.col("cnt") * HOT > self.totals[col]
        hot, rest = (own.where(c).select(F.col("level").alias("__level"), F.col("value").alias("__value"))
                     for c in (is_hot, ~is_hot))
        s = q(col).cast("string")
        names = df.columns

        def replaced(rows, value):
            return rows.select(*[value.alias(c) if c == col else q(c) for c in names])

        known = replaced(df.join(F.broadcast(hot), s == F.col("__level")), F.col("__value"))
        others = df.where(s.isNotNull()).join(F.broadcast(hot.select("__level")), s == F.col("__level"), "left_anti")
        others = replaced(others.join(rest, s == F.col("__level"), "left"), F.coalesce(F.col("__value"), default))
        return known.unionByName(others).unionByName(replaced(df.where(s.isNull()), default))


def _level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, level, cnt: one groupBy over the unpivoted columns."""
    long = df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "level")
    return long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count(F.lit(1)).alias("cnt"))


def _levels(df: DataFrame, cols: Sequence[str]) -> tuple[dict[str, list[str]], LevelTable | None]:
    """Sorted levels of the columns that have at most INLINE_LEVELS of them, and a table with the place of each level
    in that order for the columns that have more."""
    counts = written(_level_counts(df, cols), "levels")
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"), F.sum("cnt").alias("n")).collect()}
    many = [c for c in cols if c in sizes and sizes[c]["k"] > INLINE_LEVELS]
    few: dict[str, list[str]] = {c: [] for c in cols if c not in many}
    for r in counts.where(~F.col("column").isin(many)).select("column", "level").collect():
        few[r["column"]].append(r["level"])
    table = None
    if many:
        big = counts.where(F.col("column").isin(many))
        place = value_positions(big.select("column", "level"), "level", by=["column"]).select(
            "column", "level", F.col("before").cast("double").alias("value"))
        table = LevelTable(written(big.join(place, ["column", "level"]), "level-index"),
                           {c: sizes[c]["n"] for c in many}, {c: sizes[c]["k"] for c in many})
    return {c: sorted(v) for c, v in few.items()}, table


@dataclass
class OneHot(Fitted):
    """One column per level; a column with more than INLINE_LEVELS levels becomes one sparse vector ``<col>_levels``."""
    levels: dict[str, list[str]]
    table: LevelTable | None = None

    def output_names(self) -> list[str]:
        out = []
        for c, lv in self.levels.items():
            keep = lv[1:] if len(lv) == 2 else lv
            out += [f"{c}_{v}" for v in keep]
        return out + [f"{c}_levels" for c in (self.table.totals if self.table else ())]

    def transform(self, df):
        many = self.table.sizes if self.table else {}
        kept = [c for c in df.columns if c not in self.levels and c not in many]
        for c, k in many.items():
            # the library's encoder gives the level past the last one no entry
            df = self.table.lookup(df, c, F.lit(float(k)))
            top = df.sparkSession.createDataFrame([(float(k - 1),)], [c])
            df = OneHotEncoder(inputCols=[c], outputCols=[f"{c}_levels"], dropLast=True, handleInvalid="keep").fit(top).transform(df)
        extra = []
        for c, lv in self.levels.items():
            keep = lv[1:] if len(lv) == 2 else lv  # binary keeps the second level only
            s = q(c).cast("string")
            extra += [F.coalesce((s == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in keep]
        return df.select(*[q(c) for c in kept], *extra, *[q(f"{c}_levels") for c in many])


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """Unknown levels at apply time map to all zeros."""
    return OneHot(*_levels(df, cols))


@dataclass
class Ordinal(Fitted):
    levels: dict[str, list[str]]
    table: LevelTable | None = None

    def transform(self, df):
        ex = {}
        for c, lv in self.levels.items():
            m = F.create_map(*[x for i, v in enumerate(lv) for x in (F.lit(v), F.lit(float(i)))]) if lv else None
            ex[c] = F.coalesce(m[q(c).cast("string")], F.lit(-1.0)) if lv else F.lit(-1.0)
        out = self._replace(df, ex)
        for c in (self.table.totals if self.table else ()):
            out = self.table.lookup(out, c, F.lit(-1.0))
        return out


def fit_ordinal(df: DataFrame, cols: Sequence[str]) -> Ordinal:
    """Sorted levels -> 0..k-1; unknown -> -1 (missing too)."""
    return Ordinal(*_levels(df, cols))


@dataclass
class TargetEncoder(Fitted):
    """Plain (test-time) encodings per column: level -> smoothed mean."""
    maps: dict[str, dict[str, float]]
    prior: float
    table: LevelTable | None = None

    def transform(self, df):
        ex = {}
        for c, mp in self.maps.items():
            m = F.create_map(*[x for k, v in mp.items() for x in (F.lit(k), F.lit(float(v)))]) if mp else None
            ex[c] = F.coalesce(m[q(c).cast("string")], F.lit(self.prior)) if m is not None else F.lit(self.prior)
        out = self._replace(df, ex)
        for c in (self.table.totals if self.table else ()):
            out = self.table.lookup(out, c, F.lit(self.prior))
        return out


def _shrunk(sum_y: Column, sum_y2: Column, n: Column, prior: float, var_y: float) -> Column:
    mean_c = sum_y / n
    var_c = F.greatest(sum_y2 / n - mean_c * mean_c, F.lit(0.0))
    lam = n * F.lit(var_y) / (n * F.lit(var_y) + var_c)
    return lam * mean_c + (1 - lam) * F.lit(prior)


def fit_target_encoder(train: DataFrame, cols: Sequence[str], target: str, folds: int = 5,
                       key: Sequence[str] | None = None, seed: int = 42) -> tuple[TargetEncoder, DataFrame]:
    """Cross-fitted target encoding (op 117).

    Returns the plain encoder (fit on all training rows, for val/test) and the
    training rows encoded out-of-fold: for each row the statistics of its own
    fold are subtracted from the totals (groupBy(level, fold) sums, joined back
    on (level, fold) -- no per-row Python).  Shrinkage uses the empirical-Bayes
    weight n·var_y / (n·var_y + var_level).
    """
    cols = list(cols)
    y = q(target).cast("double")
    keys = [q(k) for k in (key or train.columns)]
    t = train.where(y.isNotNull()).withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)))
    st = t.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
    prior, var_y = float(st["m"]), float(st["v"] or 0.0)
    maps, totals, big = {}, {}, None
    out = t
    for c in cols:
        lf = written(t.groupBy(q(c).cast("string").alias("__lv"), "__fold").agg(
            F.sum(y).alias("sy"), F.sum(y * y).alias("sy2"), F.count(F.lit(1)).alias("n")), "level-folds")
        tot = lf.groupBy("__lv").agg(F.sum("sy").alias("ty"), F.sum("sy2").alias("ty2"), F.sum("n").alias("tn"))
        plain = tot.where("__lv is not null").select(
            F.lit(c).alias("column"), F.col("__lv").alias("level"), F.col("tn").alias("cnt"),
            _shrunk(F.col("ty"), F.col("ty2"), F.col("tn"), prior, var_y).alias("value"))
        size = plain.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()
        if size["k"] <= INLINE_LEVELS:
            maps[c] = {r["level"]: r["value"] for r in plain.collect()}
        else:
            totals[c] = size["n"]
            big = plain if big is None else big.unionByName(plain)
        # a level's rows outside the own fold; the join splits hot (level, fold) pairs
        oof = lf.where("__lv is not null").join(tot, "__lv").select(
            "__lv", "__fold", F.col("n").alias("cnt"),
            F.when(F.col("tn") - F.col("n") > 0,
                   _shrunk(F.col("ty") - F.col("sy"), F.col("ty2") - F.col("sy2"), F.col("tn") - F.col("n"),
                           prior, var_y)).otherwise(F.lit(prior)).alias("__enc"))
        keyed = out.withColumn("__lv", q(c).cast("string"))
        known = attach(keyed.where("__lv is not null"), oof, ["__lv", "__fold"], ["__enc"])
        absent = keyed.where("__lv is null").withColumn("__enc", F.lit(prior))
        out = known.unionByName(absent).withColumn(c, F.col("__enc")).drop("__lv", "__enc")
    table = LevelTable(written(big, "level-encodings"), totals) if big is not None else None
    return TargetEncoder(maps, prior, table), out.drop("__fold")


@dataclass
class LabelEncoder(Fitted):
    col: str
    classes: list[str]
    table: LevelTable | None = None

    def transform(self, df):
        if self.table:
            return self.table.lookup(df, self.col, F.lit(None).cast("double")).withColumn(self.col, q(self.col).cast("int"))
        m = F.create_map(*[x for i, v in enumerate(self.classes) for x in (F.lit(v), F.lit(i))]) if self.classes else None
        return self._replace(df, {self.col: m[q(self.col).cast("string")] if m is not None else F.lit(None).cast("int")})


def fit_label_encoder(df: DataFrame, col: str) -> LabelEncoder:
    """Sorted string levels -> 0..k-1 (op 118)."""
    few, table = _levels(df, [col])
    return LabelEncoder(col, few.get(col, []), table)


# ------------------------------------------------------------------ PCA (118a)

@dataclass
class PCAModel(Fitted):
    cols: list[str]
    mean: np.ndarray
    components: np.ndarray   # k x p
    explained_variance: np.ndarray
    whiten: bool = False

    def transform(self, df):
        k, p = self.components.shape
        if k * p > 256:
            return self._transform_batches(df)
        exprs = []
        for j in range(self.components.shape[0]):
            e = F.lit(0.0)
            for i, c in enumerate(self.cols):
                e = e + (q(c).cast("double") - F.lit(float(self.mean[i]))) * F.lit(float(self.components[j, i]))
            if self.whiten:
                e = e / F.lit(float(math.sqrt(self.explained_variance[j])))
            exprs.append(e.alias(f"pca{j}"))
        return df.select(*[q(c) for c in df.columns if c not in self.cols], *exprs)

    def _transform_batches(self, df):
        """Many components x inputs: project each Arrow batch with one numpy
        matrix product instead of k·p scalar expressions."""
        from pyspark.sql import types as T
        keep = [c for c in df.columns if c not in self.cols]
        k = self.components.shape[0]
        schema = T.StructType([*[f for f in df.schema.fields if f.name in keep],
                               *[T.StructField(f"pca{j}", T.DoubleType()) for j in range(k)]])
        cols, mean, comp = list(self.cols), self.mean.copy(), self.components.copy()
        scale = np.sqrt(self.explained_variance) if self.whiten else np.ones(k)

        def fn(batches):
            import pandas as pd
            for pdf in batches:
                z = (pdf[cols].to_numpy(dtype="float64") - mean) @ comp.T / scale
                out = pdf[keep].copy()
                proj = pd.DataFrame(z, columns=[f"pca{j}" for j in range(k)], index=pdf.index)
                yield pd.concat([out, proj], axis=1)
        return df.mapInPandas(fn, schema)


def fit_pca(df: DataFrame, cols: Sequence[str], n_components: float | int | None = None,
            whiten: bool = False) -> PCAModel:
    """Eigen-decomposition of the p×p covariance from one Gram pass; k given as
    a count or as a share of variance to keep (sign fixed: largest |loading| > 0)."""
    cols = list(cols)
    g = total(gram(df, cols))
    cov = g.cov
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    if n_components is None:
        k = len(cols)
    elif isinstance(n_components, float) and 0 < n_components < 1:
        share = np.cumsum(vals) / vals.sum()
        k = int(np.searchsorted(share, n_components) + 1)
    else:
        k = int(n_components)
    return PCAModel(cols, g.mean, vecs[:, :k].T, vals[:k], whiten)


# ---------------------------------------------------------- k-means features (118b)

@dataclass
class KMeansFeatures(Fitted):
    cols: list[str]
    centers: np.ndarray
    add_distances: bool = True
    add_onehot: bool = False

    def transform(self, df):
        d = []
        for j, ctr in enumerate(self.centers):
            s = F.lit(0.0)
            for i, c in enumerate(self.cols):
                s = s + F.pow(q(c).cast("double") - F.lit(float(ctr[i])), 2)
            d.append(F.sqrt(s))
        out = []
        if self.add_distances:
            out += [e.alias(f"kmeans_dist_{j}") for j, e in enumerate(d)]
        if self.add_onehot:
            label = F.array_position(F.array(*d), F.least(*d)) - 1 if len(d) > 1 else F.lit(0)
            out += [(label == j).cast("double").alias(f"kmeans_label_{j}") for j in range(len(d))]
        if not out:
            return df
        # cluster features replace the inputs
        return df.select(*[q(c) for c in df.columns if c not in self.cols], *out)


def fit_kmeans_features(df: DataFrame, cols: Sequence[str], k: int = 5, seed: int = 42,
                        add_distances: bool = True, add_onehot: bool = False) -> KMeansFeatures:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="__f", handleInvalid="skip")
    model = KMeans(k=k, seed=seed, featuresCol="__f").fit(va.transform(df.select(*[q(c).cast("double").alias(c) for c in cols])))
    return KMeansFeatures(list(cols), np.array(model.clusterCenters()), add_distances, add_onehot)
