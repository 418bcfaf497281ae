"""Column classes, missing-value normalisation and shared Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def is_numeric_type(dt: T.DataType) -> bool:
    """int/float columns count as numeric; decimal, bool and nested types do not."""
    return isinstance(dt, _INTEGRAL + _FRACTIONAL)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_categorical_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_cols(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    wanted = set(cols) if cols is not None else None
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and (wanted is None or f.name in wanted)]


def categorical_cols(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    wanted = set(cols) if cols is not None else None
    return [f.name for f in df.schema.fields
            if is_categorical_type(f.dataType) and (wanted is None or f.name in wanted)]


def supported_cols(df: DataFrame) -> list[str]:
    """Columns an operator may select: numeric, categorical or datetime."""
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) or is_categorical_type(f.dataType)
            or is_datetime_type(f.dataType)]


def select_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Project, rejecting unsupported (nested, decimal, binary) types by name."""
    cols = list(cols)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    bad = [c for c in cols if c in types and not (
        is_numeric_type(types[c]) or is_categorical_type(types[c]) or is_datetime_type(types[c]))]
    if bad:
        raise TypeError(f"unsupported column types: {bad}")
    missing = [c for c in cols if c not in types]
    if missing:
        raise KeyError(f"unknown columns: {missing}")
    return df.select(*cols)


def q(name: str) -> Column:
    """Column by exact name (names may hold dots or spaces)."""
    return F.col(f"`{name}`")


def normalize_missing(df: DataFrame) -> DataFrame:
    """Map NaN to NULL on every float column so operators see one missing marker."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _FRACTIONAL):
            exprs.append(F.nanvl(q(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(q(f.name))
    return df.select(*exprs)


def as_double(c: Column) -> Column:
    return c.cast("double")


def round_doubles(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (for comparisons across engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _FRACTIONAL):
            out.append(F.round(q(f.name), dp).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def skew_g1(pop_skew: Column, n: Column) -> Column:
    """Bias-corrected sample skewness G1 from Spark's population skewness g1."""
    n = n.cast("double")
    return F.when(n > 2, pop_skew * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(pop_kurt: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population excess kurtosis g2."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * pop_kurt + 6))


# Duplicate-name suffix format is "<name>_<k>", k counting from 1.
def make_unique_columns(cols: Iterable[object]) -> list[str]:
    """Rename duplicate labels a, a, b, a -> a, a_1, b, a_2."""
    seen: dict[str, int] = {}
    used: set[str] = set()
    out = []
    for c in cols:
        name = str(c)
        if name not in seen:
            seen[name] = 0
            out.append(name)
            used.add(name)
            continue
        k = seen[name]
        cand = name
        while cand in used:
            k += 1
            cand = f"{name}_{k}"
        seen[name] = k
        used.add(cand)
        out.append(cand)
    return out


COPY_CHUNK = 100_000


def explode_copies(df, count: str, name: str):
    """Each row ``count`` times, numbered from 0 in ``name``.  Done in two
    steps, so that no array of one row grows with a hot row's count."""
    n = F.col(count)
    parts = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(COPY_CHUNK).cast("long"))).alias("__from"))
    upto = F.least(n, F.col("__from") + COPY_CHUNK) - 1
    return parts.select("*", F.explode(F.sequence("__from", upto)).alias(name)).drop("__from")
