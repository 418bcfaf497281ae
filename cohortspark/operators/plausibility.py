"""Unit inference, unit harmonisation and plausibility gates (ops 65-69b).

Reference intervals and unit hypotheses are small dimension tables; a user can
pass their own as a DataFrame.  All per-column checks for all columns are one
fused aggregation with one conditional sum per (column, hypothesis).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import q

# Clinical variables, canonical unit and unit hypotheses
# (unit, factor to canonical, plausible range as written).
CLINICAL_VARIABLES = {
    "weight": ("kg", [("kg", 1.0, (30, 200)), ("lb", 0.453592, (66, 440))]),
    "height": ("cm", [("cm", 1.0, (100, 220)), ("inches", 2.54, (39, 87)),
                      ("meters", 100.0, (1.0, 2.2))]),
    "waist": ("cm", [("cm", 1.0, (50, 150)), ("inches", 2.54, (20, 59))]),
    "glucose": ("mg/dL", [("mg/dL", 1.0, (70, 125)), ("mmol/L", 18.0, (3.9, 6.9))]),
    "cholesterol": ("mmol/L", [("mmol/L", 1.0, (2.0, 10.0)), ("mg/dL", 0.0259, (80, 400))]),
    "triglyceride": ("mg/dL", [("mg/dL", 1.0, (50, 499)), ("mmol/L", 88.57, (0.57, 5.64))]),
    "bp_sys": ("mmHg", [("mmHg", 1.0, (80, 200))]),
    "bp_di": ("mmHg", [("mmHg", 1.0, (40, 120))]),
    "bmi": ("kg/m²", [("kg/m²", 1.0, (15, 50))]),
    "hba1c": ("%", [("%", 1.0, (4.0, 15.0))]),
    "kcal": ("kcal", [("kcal", 1.0, (500, 5000)), ("kJ", 0.239, (2100, 21000))]),
}

# Guideline bands per variable and unit, [lo, hi) with hi None = open.
GUIDELINE_BANDS = {
    "glucose": {
        "mg/dL": [("normal", 70, 99), ("prediabetes", 100, 125), ("diabetes", 126, None)],
        "mmol/L": [("normal", 3.9, 5.5), ("prediabetes", 5.6, 6.9), ("diabetes", 7.0, None)],
    },
    "triglyceride": {
        "mg/dL": [("normal", 0, 149), ("borderline_high", 150, 199), ("high", 200, 499),
                  ("very_high", 500, None)],
        "mmol/L": [("normal", 0, 1.68), ("borderline_high", 1.69, 2.25), ("high", 2.26, 5.64),
                   ("very_high", 5.65, None)],
    },
}

# Default population reference intervals (p01, p99) in canonical units.
DEFAULT_REFERENCE = {
    "glucose": ("mg/dL", 70, 200),
    "bmi": ("kg/m²", 15, 50),
    "hba1c": ("%", 4.0, 15.0),
    "cholesterol": ("mmol/L", 2.0, 10.0),
    "triglyceride": ("mg/dL", 50, 500),
    "weight": ("kg", 35, 200),
    "height": ("cm", 140, 210),
    "waist": ("cm", 55, 150),
    "bp_sys": ("mmHg", 90, 200),
    "bp_di": ("mmHg", 50, 120),
    "kcal": ("kcal", 800, 4500),
}


def match_variable(col: str, keys: Sequence[str]) -> str | None:
    low = col.lower()
    for k in keys:
        if k in low:
            return k
    return None


def reference_table(spark: SparkSession, reference: Mapping | None = None) -> DataFrame:
    """Reference bounds as a small dimension DataFrame (variable, unit, p01, p99)."""
    ref = reference or DEFAULT_REFERENCE
    rows = [(k, u, float(lo), float(hi)) for k, (u, lo, hi) in ref.items()]
    return spark.createDataFrame(rows, "variable string, unit string, p01 double, p99 double")


# ---------------------------------------------------------- unit inference (65)

def infer_units(df: DataFrame, cols: Sequence[str], compat: bool = False) -> DataFrame:
    """Score every unit hypothesis of every clinical column in one scan.

    score = share in range - 0.5 * share beyond 2 range widths.  By default the
    raw values are compared with each range as it is written (in the source
    unit); ``compat=True`` compares converted values instead, as the original
    tool does.  Returns one row per column with the best hypothesis and a
    confidence (>= .9 high, >= .7 med, else low).
    """
    hyps = []
    for c in cols:
        var = match_variable(c, list(CLINICAL_VARIABLES))
        if var is None:
            continue
        canon, hs = CLINICAL_VARIABLES[var]
        for order, (unit, factor, (lo, hi)) in enumerate(hs):
            hyps.append((c, var, canon, order, unit, factor, lo, hi))
    if not hyps:
        raise ValueError("no clinical columns among the given names")
    exprs = []
    for i, (c, _v, _cn, _o, _u, factor, lo, hi) in enumerate(hyps):
        x = q(c).cast("double") * (F.lit(factor) if compat else F.lit(1.0))
        width = hi - lo
        exprs += [F.sum(((x >= lo) & (x <= hi)).cast("long")).alias(f"h{i}_in"),
                  F.sum(((x < lo - 2 * width) | (x > hi + 2 * width)).cast("long")).alias(f"h{i}_ext"),
                  F.count(x).alias(f"h{i}_n")]
    row = df.agg(*exprs)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(v).alias("variable"),
                        F.lit(cn).alias("canonical_unit"), F.lit(o).alias("h_order"),
                        F.lit(u).alias("unit"), F.lit(float(f)).alias("factor"),
                        F.col(f"h{i}_in").alias("n_in"), F.col(f"h{i}_ext").alias("n_ext"),
                        F.col(f"h{i}_n").alias("n"))
               for i, (c, v, cn, o, u, f, _lo, _hi) in enumerate(hyps)]
    long = row.select(F.inline(F.array(*structs))).where(F.col("n") > 0)
    fit = F.col("n_in") / F.col("n")
    scored = long.select("*", fit.alias("fit_share"),
                         (fit - F.col("n_ext") / F.col("n") * 0.5).alias("score"))
    # tiny: (columns x hypotheses) rows
    w = Window.partitionBy("column").orderBy(F.desc("score"), "h_order")
    best = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(
        "column", "variable", "canonical_unit", F.col("unit").alias("inferred_unit"),
        "factor", "fit_share", "score",
        F.when(F.col("fit_share") >= 0.9, "high").when(F.col("fit_share") >= 0.7, "med")
         .otherwise("low").alias("confidence"))


# ------------------------------------------------------ harmonisation (66)

def harmonize_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """x * factor per listed column (unknown -> 1)."""
    return df.select(*[(q(c) * F.lit(float(factors[c]))).alias(c) if c in factors else q(c)
                       for c in df.columns])


def unit_factors(inferred: DataFrame, overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    """Driver dict column -> factor from ``infer_units`` (O(columns))."""
    out = {r["column"]: r["factor"] for r in inferred.select("column", "factor").collect()}
    out.update(overrides or {})
    return out


# ----------------------------------------------------- reference bounds (67)

def plausibility_bounds(cols: Sequence[str], factors: Mapping[str, float] | None = None,
                        reference: Mapping | None = None) -> dict[str, tuple[float, float]]:
    """Column -> (lo, hi) in the column's own unit (canonical bounds / factor)."""
    ref = reference or DEFAULT_REFERENCE
    out = {}
    for c in cols:
        key = match_variable(c, list(ref))
        if key is None:
            continue
        _u, lo, hi = ref[key]
        f = float((factors or {}).get(c, 1.0)) or 1.0
        out[c] = (lo / f, hi / f)
    return out


def bounds_from_table(bounds: DataFrame, col_key: str = "column") -> dict[str, tuple[float, float]]:
    """User-supplied bounds table (column, lower, upper) -> driver dict (small)."""
    return {r[col_key]: (r["lower"], r["upper"]) for r in bounds.collect()}


# ------------------------------------------------------------- gates (68-69)

def plausibility_gate(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Out-of-range values become NULL (op 68)."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            out.append(F.when(q(c).between(F.lit(lo), F.lit(hi)), q(c)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def plausibility_filter(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows whose gated columns are all in range; a NULL drops the row (op 69)."""
    cond: Column | None = None
    for c, (lo, hi) in bounds.items():
        t = q(c).between(F.lit(lo), F.lit(hi))
        cond = t if cond is None else (cond & t)
    return df if cond is None else df.where(F.coalesce(cond, F.lit(False)))


# --------------------------------------------------------------- report (69a)

def plausibility_report(df: DataFrame, bounds: Mapping[str, tuple[float, float]],
                        factors: Mapping[str, float] | None = None,
                        flag_share: float = 0.05) -> DataFrame:
    """min/max in canonical units, share out of range, flag above 5 %."""
    cols = list(bounds)
    exprs = []
    for i, c in enumerate(cols):
        f = float((factors or {}).get(c, 1.0))
        x = q(c).cast("double") * F.lit(f)
        lo, hi = bounds[c]
        lo_c, hi_c = lo * f, hi * f
        exprs += [F.count(x).alias(f"c{i}_n"), F.min(x).alias(f"c{i}_min"), F.max(x).alias(f"c{i}_max"),
                  F.sum(((x < lo_c) | (x > hi_c)).cast("long")).alias(f"c{i}_out")]
    row = df.agg(*exprs)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(float(bounds[c][0])).alias("lower"),
                        F.lit(float(bounds[c][1])).alias("upper"),
                        F.col(f"c{i}_n").alias("n"), F.col(f"c{i}_min").alias("min_canonical"),
                        F.col(f"c{i}_max").alias("max_canonical"),
                        F.coalesce(F.col(f"c{i}_out"), F.lit(0)).cast("long").alias("n_out"))
               for i, c in enumerate(cols)]
    long = row.select(F.inline(F.array(*structs)))
    share = F.when(F.col("n") > 0, F.col("n_out") / F.col("n")).otherwise(0.0)
    return long.select("*", share.alias("out_share"), (share > flag_share).alias("flagged"))


# -------------------------------------------------------- guideline bands (69b)

def guideline_bands(df: DataFrame, col: str, variable: str, unit: str) -> DataFrame:
    """Share of non-null values per band on half-open [lo, hi) bands.

    The published limits are inclusive integers, so half-open bands leave gaps
    (99-100 for glucose); the share that falls in no band is reported too.
    """
    bands = GUIDELINE_BANDS[variable][unit]
    x = q(col).cast("double")
    exprs = [F.count(x).alias("n")]
    in_any = None
    for i, (_name, lo, hi) in enumerate(bands):
        cond = (x >= lo) if hi is None else ((x >= lo) & (x < hi))
        exprs.append(F.sum(cond.cast("long")).alias(f"b{i}"))
        in_any = cond if in_any is None else (in_any | cond)
    exprs.append(F.sum((x.isNotNull() & ~F.coalesce(in_any, F.lit(False))).cast("long")).alias("bnone"))
    row = df.agg(*exprs)
    structs = [F.struct(F.lit(name).alias("band"), F.lit(i).alias("band_order"),
                        F.coalesce(F.col(f"b{i}"), F.lit(0)).cast("long").alias("count"), F.col("n").alias("n"))
               for i, (name, _lo, _hi) in enumerate(bands)]
    structs.append(F.struct(F.lit("unbanded").alias("band"), F.lit(len(bands)).alias("band_order"),
                            F.coalesce(F.col("bnone"), F.lit(0)).cast("long").alias("count"),
                            F.col("n").alias("n")))
    long = row.select(F.inline(F.array(*structs)))
    return long.select(F.lit(col).alias("column"), "band", "band_order", "count",
                       F.when(F.col("n") > 0, F.col("count") / F.col("n")).otherwise(0.0).alias("share"))
