"""Table audit: summary, cardinality, types, missingness, duplicates, numeric
statistics, outlier flags and the cleaning actions built on them (ops 15-42).

All per-column work for all columns is one fused aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import (by_column, distinct_counts, per_column, scalar_quantiles, unpivot_stats,
                                        wide_agg)
from cohortspark.functions.quantiles import modes
from cohortspark.functions.columns import (categorical_cols, is_categorical_type,
                                           is_numeric_type, kurt_g2, numeric_cols, q,
                                           skew_g1)


# ---------------------------------------------------------------- shape (15, 17, 18)

def orientation(df: DataFrame) -> DataFrame:
    """Wide if cols > 2*rows and cols > 10; tall if rows > 10*cols and rows > 100."""
    p = len(df.columns)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.lit(p).cast("long").alias("n_cols"),
        F.when((F.lit(p) > 2 * n) & (F.lit(p) > 10), "wide")
         .when((n > 10 * p) & (n > 100), "tall")
         .otherwise("normal").alias("orientation"))


def column_classes(df: DataFrame) -> DataFrame:
    """Per column: numeric / categorical / other, and whether it has a value."""
    cols = df.columns
    row = wide_agg(df, cols, {"non_null": lambda c: F.count(c)})
    kinds = {f.name: ("numeric" if is_numeric_type(f.dataType) else
                      "categorical" if is_categorical_type(f.dataType) else "other")
             for f in df.schema.fields}
    long = unpivot_stats(row, cols, ["non_null"])
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    return long.select("column", kind_map[F.col("column")].alias("kind"),
                       (F.col("non_null") > 0).alias("selectable"))


def get_numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns with at least one non-null value (one agg)."""
    cols = numeric_cols(df)
    if not cols:
        return []
    row = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] > 0]


def get_categorical_columns(df: DataFrame) -> list[str]:
    cols = categorical_cols(df)
    if not cols:
        return []
    row = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] > 0]


# ------------------------------------------------------------------ summary (36)

def duplicate_row_count(df: DataFrame) -> DataFrame:
    """n - distinct rows, as one partial-aggregated groupBy over all columns."""
    g = df.groupBy(*[q(c) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and %, numeric columns, duplicate rows.

    One groupBy over all columns (map-side combined) gives copies per distinct
    row; rows, duplicates and missing cells all follow from it -- no join.
    """
    cols = df.columns
    p = len(cols)
    n_num = len(numeric_cols(df))
    row_nulls = sum([q(c).isNull().cast("long") for c in cols], F.lit(0).cast("long"))
    g = (df.select(*[q(c) for c in cols], row_nulls.alias("__nulls"))
         .groupBy(*[q(c) for c in cols], "__nulls").agg(F.count(F.lit(1)).alias("__k")))
    base = g.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("long").alias("n_rows"),
                 F.coalesce(F.sum(F.col("__k") * F.col("__nulls")), F.lit(0)).cast("long").alias("missing_cells"),
                 F.coalesce(F.sum(F.col("__k") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return base.select(
        "n_rows", F.lit(p).cast("long").alias("n_cols"), "missing_cells",
        F.when(F.col("n_rows") * p > 0,
               F.col("missing_cells") * 100.0 / (F.col("n_rows") * p)).otherwise(0.0)
         .alias("missing_pct"),
        F.lit(n_num).cast("long").alias("numeric_cols"), "duplicate_rows")


# -------------------------------------------------------------- cardinality (37)

# Cardinality classes, tested in this order.
CARDINALITY_CLASSES = ("Constant", "Binary", "Unique (potential ID)", "Low cardinality",
                       "Moderate cardinality", "High cardinality (near-unique)",
                       "High cardinality")


def cardinality_class(n_unique: Column, n: Column) -> Column:
    pct = n_unique * 100.0 / n
    return (F.when(n_unique == 1, CARDINALITY_CLASSES[0])
            .when(n_unique == 2, CARDINALITY_CLASSES[1])
            .when(n_unique == n, CARDINALITY_CLASSES[2])
            .when(n_unique <= 10, CARDINALITY_CLASSES[3])
            .when(n_unique <= 50, CARDINALITY_CLASSES[4])
            .when(pct > 90, CARDINALITY_CLASSES[5])
            .otherwise(CARDINALITY_CLASSES[6]))


def _unique(df: DataFrame, cols: Sequence[str], approx: bool) -> list[Column]:
    """Number of distinct values per column, for the row of unpivot_stats: sketches, or exact counts as literals."""
    exact = None if approx else distinct_counts(df, cols)
    return [(F.approx_count_distinct(q(c)) if approx else F.lit(exact[c]).cast("long")).alias(f"c{i}__n_unique")
            for i, c in enumerate(cols)]


def cardinality_table(df: DataFrame, cols: Sequence[str] | None = None,
                      approx: bool = False) -> DataFrame:
    """column, n_unique, pct_unique, cardinality class (missing values excluded)."""
    cols = list(cols or df.columns)
    row = df.agg(*_unique(df, cols, approx), F.count(F.lit(1)).alias("__n"))
    long = unpivot_stats(row, cols, ["n_unique"], keep=["__n"])
    n = F.col("__n")
    return long.select(
        "column", F.col("n_unique").cast("long").alias("n_unique"),
        F.when(n > 0, F.col("n_unique") * 100.0 / n).otherwise(0.0).alias("pct_unique"),
        cardinality_class(F.col("n_unique"), n).alias("cardinality"))


# ----------------------------------------------------------- type/validity (38)

def type_validity_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """dtype, non-null, null, unique, mixed-types flag for string columns."""
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    stats = {
        "non_null": lambda c: F.count(c),
        "nulls": lambda c: F.sum(c.isNull().cast("long")),
    }
    row = wide_agg(df, cols, stats, extra=_unique(df, cols, approx) + [
        F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"c{i}__num")
        for i, c in enumerate(cols) if types[c].typeName() == "string"])
    structs = []
    for i, c in enumerate(cols):
        is_str = types[c].typeName() == "string"
        num = F.col(f"c{i}__num") if is_str else F.lit(None).cast("long")
        nn = F.col(f"c{i}__non_null")
        mixed = ((num > 0) & (num < nn)) if is_str else F.lit(False)
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"),
            nn.cast("long").alias("non_null"), F.col(f"c{i}__nulls").cast("long").alias("nulls"),
            F.col(f"c{i}__n_unique").cast("long").alias("n_unique"),
            F.coalesce(mixed, F.lit(False)).alias("mixed_types")))
    return row.select(F.inline(F.array(*structs)))


# ----------------------------------------------------------------- missing (39)

def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: count and % of rows, sorted by count desc."""
    cols = list(cols or df.columns)
    row = wide_agg(df, cols, {"missing_count": lambda c: F.sum(c.isNull().cast("long"))},
                   extra=[F.count(F.lit(1)).alias("__n")])
    long = unpivot_stats(row, cols, ["missing_count"], keep=["__n"])
    return (long.where(F.col("missing_count") > 0)
            .select("column", F.col("missing_count").cast("long").alias("missing_count"),
                    (F.col("missing_count") * 100.0 / F.col("__n")).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "column"))


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Driver dict column -> missing share (O(columns) scalars)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(q(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = row["n"] or 0
    return {c: ((row[f"m{i}"] or 0) / n if n else 0.0) for i, c in enumerate(cols)}


# -------------------------------------------------------------- duplicates (40)

def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every row value that occurs more than once, with its number of copies.

    The compact form of "all members of duplicate groups": one row per group
    instead of re-joining all copies (the copies are identical by definition).
    """
    cols = list(cols or df.columns)
    return (df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("n_copies"))
            .where(F.col("n_copies") > 1))


def duplicate_rows_sample(df: DataFrame, k: int = 10) -> DataFrame:
    """First k members of duplicate groups in a deterministic (sorted) order."""
    groups = duplicate_groups(df)
    members = groups.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("_k"))
    return members.drop("_k").orderBy(*df.columns).limit(k)


# --------------------------------------------------------- numeric summary (41)

def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    quantile_method: str = "exact") -> DataFrame:
    """count, mean, sd (n-1), min, q25, median, q75, max, skew G1, kurt G2."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    stats = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "g1": lambda c: F.skewness(c.cast("double")),
        "g2": lambda c: F.kurtosis(c.cast("double")),
    }
    quart = scalar_quantiles(df, cols, [0.25, 0.5, 0.75], quantile_method)
    long = per_column(df, cols, stats)
    n = F.col("count")
    return long.select(
        "column", n.cast("long").alias("count"), "mean", "std", "min",
        *[by_column({c: v[k] for c, v in quart.items()}).alias(name) for k, name in enumerate(("q25", "median", "q75"))],
        "max",
        skew_g1(F.col("g1"), n).alias("skewness"), kurt_g2(F.col("g2"), n).alias("kurtosis"))


# ------------------------------------------------------------ IQR flags (42)

def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5,
               quantile_method: str = "exact") -> dict[str, tuple[float | None, float | None]]:
    """Driver dict column -> (lower, upper); O(columns) scalars."""
    vals = scalar_quantiles(df, cols, [0.25, 0.75], quantile_method)
    out = {}
    for c in cols:
        qq = vals[c]
        if qq[0] is None:
            out[c] = (None, None)
            continue
        iqr = qq[1] - qq[0]
        out[c] = (qq[0] - k * iqr, qq[1] + k * iqr)
    return out


def iqr_outlier_flags(df: DataFrame, cols: Sequence[str] | None = None,
                      share: float = 0.05, quantile_method: str = "exact") -> DataFrame:
    """Per column: count outside Q1-1.5 IQR..Q3+1.5 IQR; flagged when > share*n.

    Two scans: one fused quantile agg (bounds come back as scalars), one fused
    conditional-count agg with the bounds inlined as literals.
    """
    cols = list(cols) if cols is not None else numeric_cols(df)
    bounds = iqr_bounds(df, cols, quantile_method=quantile_method)

    def outside(c: str) -> Column:
        lo, hi = bounds[c]
        if lo is None:
            return F.lit(0).cast("long")
        x = q(c).cast("double")
        return F.sum(((x < F.lit(lo)) | (x > F.lit(hi))).cast("long"))

    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[outside(c).alias(f"c{i}__outliers") for i, c in enumerate(cols)])
    long = unpivot_stats(row, cols, ["outliers"], keep=["__n"])
    lo_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(bounds[c][0]).cast("double"))])
    hi_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(bounds[c][1]).cast("double"))])
    return long.select(
        "column", lo_map[F.col("column")].alias("lower"), hi_map[F.col("column")].alias("upper"),
        F.coalesce(F.col("outliers"), F.lit(0)).cast("long").alias("outlier_count"),
        (F.coalesce(F.col("outliers"), F.lit(0)) * 100.0 / F.col("__n")).alias("outlier_pct"),
        (F.coalesce(F.col("outliers"), F.lit(0)) > F.col("__n") * share).alias("flagged"))


# ---------------------------------------------------- cleaning actions (21-25)

def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(q(target).isNotNull())


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = list(cols or df.columns)
    card = distinct_counts(df, cols)
    return [c for c in cols if card[c] == 1]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    consts = constant_columns(df)
    if len(consts) >= len(df.columns):
        return df
    return df.drop(*consts)


def drop_high_missing_columns(df: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    rates = missing_rates(df)
    drop = [c for c, r in rates.items() if r * 100 > threshold_pct]
    if not drop or len(drop) >= len(df.columns):
        return df
    return df.drop(*drop)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def simple_impute_values(df: DataFrame, cols: Sequence[str] | None = None,
                         quantile_method: str = "exact") -> dict[str, object]:
    """Fill values: median for numeric columns, mode (smallest on ties) else ''."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric_type(types[c])]
    medians = scalar_quantiles(df, num, [0.5], quantile_method)
    common = modes(df, {c: q(c) for c in cols if c not in num})
    return {c: medians[c][0] if c in medians else "" if common[c] is None else common[c] for c in cols}


def simple_impute(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Median/mode fill of every column that has missing values (op 25)."""
    cols = list(cols or df.columns)
    rates = missing_rates(df, cols)
    todo = [c for c in cols if rates[c] > 0]
    if not todo:
        return df
    fill = simple_impute_values(df, todo)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in fill and fill[c] is not None:
            out.append(F.coalesce(q(c), F.lit(fill[c]).cast(types[c])).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def preview(df: DataFrame, k: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First k rows in a deterministic order (op 28)."""
    keys = list(order_by or df.columns)
    return df.orderBy(*[q(c) for c in keys]).limit(k)
