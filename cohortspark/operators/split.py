"""Splits, folds and resampling weights (ops 70-70g).

Everything random is a keyed hash, ``xxhash64(seed, key...)``, so results do
not depend on partitioning or row order and survive task retries.  Exact
quotas and the time split use selection by histogram refinement: a few scans
with bounded outputs, never a global window or a sort into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import q
from cohortspark.operators.ranks import value_positions

_TWO64 = float(2 ** 64)


def uniform(seed: int, *keys: Column) -> Column:
    """A U[0, 1) number per row from a 64-bit hash of (seed, keys)."""
    h = F.xxhash64(F.lit(seed), *keys).cast("double")
    return (h + F.lit(2.0 ** 63)) / F.lit(_TWO64)


def _keys(df: DataFrame, key: Sequence[str] | None) -> list[Column]:
    return [q(k) for k in (key or df.columns)]


def random_split(df: DataFrame, key: Sequence[str] | None = None, train: float = 0.70,
                 val: float = 0.15, seed: int = 42, col: str = "split") -> DataFrame:
    """train / val / test by hash threshold (op 70)."""
    u = uniform(seed, *_keys(df, key))
    part = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return df.withColumn(col, part)


def group_split(df: DataFrame, group: str, train: float = 0.70, val: float = 0.15,
                seed: int = 42, col: str = "split") -> DataFrame:
    """No entity in two parts: the hash is of the entity id only (op 70b)."""
    return random_split(df, [group], train, val, seed, col)


def _class_key(label: str):
    """The label as a key that joins: a missing label is a class of its own."""
    return F.coalesce(F.concat(F.lit("="), q(label).cast("string")), F.lit("missing"))


def stratified_split(df: DataFrame, label: str, key: Sequence[str] | None = None, train: float = 0.70,
                     val: float = 0.15, seed: int = 42, col: str = "split") -> DataFrame:
    """Exact per-class quotas (op 70a): rows ranked by hash inside each class with
    the distributed position primitive; the first ⌊n_c·train⌋ go to train, the
    next ⌊n_c·val⌋ to val."""
    h = F.xxhash64(F.lit(seed), *_keys(df, key))
    t = df.withColumn("__h", h).withColumn("__class", _class_key(label))
    pos = value_positions(t, "__h", by=["__class"])
    sizes = t.groupBy("__class").agg(F.count(F.lit(1)).alias("__nc"))
    p = pos.join(sizes, "__class").select("__class", "__h", "before", "__nc")
    part = (F.when(F.col("before") < F.floor(F.col("__nc") * train), "train")
            .when(F.col("before") < F.floor(F.col("__nc") * train) + F.floor(F.col("__nc") * val), "val")
            .otherwise("test"))
    return t.join(p.select("__class", "__h", part.alias(col)), ["__class", "__h"], "left").drop("__h", "__class")


def kth_composite(df: DataFrame, a: str, b: str, k: int, bins: int = 4096) -> tuple[int, int]:
    """The k-th smallest (a, b) pair (0-based) over long columns, by histogram
    refinement: each scan counts rows per equal-width bucket of the current
    interval; the interval shrinks by ``bins`` per scan."""
    pairs = df.select(q(a).cast("long").alias("a"), q(b).cast("long").alias("b")).dropna()
    before = 0

    def narrow(col, lo, hi, cond, before, k):
        while lo < hi:
            width = max(1, -(-(hi - lo + 1) // bins))
            bk = F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("long")
            counts = sorted((r["bk"], r["n"]) for r in pairs.where(cond & (F.col(col) >= lo) & (F.col(col) <= hi))
                            .groupBy(bk.alias("bk")).agg(F.count(F.lit(1)).alias("n")).collect())
            for bi, n in counts:
                if before + n > k:
                    lo, hi = lo + bi * width, min(hi, lo + (bi + 1) * width - 1)
                    break
                before += n
            if width == 1:
                break
        return lo, before

    st = pairs.agg(F.min("a").alias("mn"), F.max("a").alias("mx")).first()
    av, before = narrow("a", st["mn"], st["mx"], F.lit(True), 0, k)
    sb = pairs.where(F.col("a") == av).agg(F.min("b").alias("mn"), F.max("b").alias("mx")).first()
    bv, _ = narrow("b", sb["mn"], sb["mx"], F.col("a") == av, before, k)
    return av, bv


def _micros(df: DataFrame, col: str) -> Column:
    """Order-preserving long for a time column, independent of the session time
    zone (local timestamps are measured from the local epoch, no conversion)."""
    from pyspark.sql import types as T
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[col]
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(q(col))
    if isinstance(dt, T.DateType):
        return F.unix_date(q(col)).cast("long") * 86_400_000_000
    return q(col).cast("long")


def time_split(df: DataFrame, time_col: str, key: str, train: float = 0.70, val: float = 0.15,
               col: str = "split") -> DataFrame:
    """Sort by (time, key): first int(n·train) rows train, next int(n·val) val,
    rest test (op 70c).  ``key`` must make (time, key) unique."""
    t = df.withColumn("__a", _micros(df, time_col)).withColumn("__b", q(key).cast("long"))
    n = t.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).count()
    n_tr, n_va = int(n * train), int(n * val)

    def below(k):
        if k >= n:
            return F.lit(True)
        a, b = kth_composite(t, "__a", "__b", k)
        return (F.col("__a") < a) | ((F.col("__a") == a) & (F.col("__b") < b))
    part = F.when(below(n_tr), "train").when(below(n_tr + n_va), "val").otherwise("test")
    return t.withColumn(col, part).drop("__a", "__b")


def kfold(df: DataFrame, k: int = 5, key: Sequence[str] | None = None, seed: int = 42,
          col: str = "fold") -> DataFrame:
    """Shuffled k folds from the hash (op 70e)."""
    return df.withColumn(col, F.pmod(F.xxhash64(F.lit(seed), *_keys(df, key)), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, label: str, k: int = 5, key: Sequence[str] | None = None,
                     seed: int = 42, col: str = "fold") -> DataFrame:
    """Class-balanced folds: hash rank inside each class, fold = rank mod k."""
    t = df.withColumn("__h", F.xxhash64(F.lit(seed), *_keys(df, key))).withColumn("__class", _class_key(label))
    pos = value_positions(t, "__h", by=["__class"]).select("__class", "__h", (F.col("before") % k).cast("int").alias(col))
    return t.join(pos, ["__class", "__h"], "left").drop("__h", "__class")


# ------------------------------------------------------------ resampling weights

# Cumulative Poisson(1) probabilities P(K <= k), k = 0..9.
_POISSON1_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
                 0.9999988747974149, 0.9999998874797414)


def poisson1(u: Column) -> Column:
    """Inverse CDF of Poisson(1) at u (counts above 10 have probability < 1e-7)."""
    e = F.lit(10)
    for kk in range(len(_POISSON1_CDF) - 1, -1, -1):
        e = F.when(u < F.lit(_POISSON1_CDF[kk]), F.lit(kk)).otherwise(e)
    return e.cast("int")


def bootstrap_weight(replicate: Column, seed: int, *keys: Column) -> Column:
    """Case-bootstrap multiplicity of a row in a replicate (op 70f)."""
    return poisson1(uniform(seed, replicate, *keys))


def subsample_flag(replicate: Column, seed: int, *keys: Column, fraction: float = 0.5) -> Column:
    """Half-sample membership per replicate (op 70g)."""
    return uniform(seed + 7919, replicate, *keys) < F.lit(fraction)
