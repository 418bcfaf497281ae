"""Gram primitive: per-key weighted sufficient statistics of a numeric block.

``gram(df, cols, by, weight)`` returns, for each key, Σw, Σw·(x-c) and
Σw·(x-c)(x-c)' with c the column means from a first fused aggregation (for
numerical stability).  Partial sums are built per Arrow batch with numpy
(``mapInPandas``), one small record per (task, key) leaves each task, and
``reduceByKey`` adds them with map-side combining.  The driver receives
O(p²) numbers per key -- linear models, correlation, VIF, PCA and all fold /
replicate fits are then p×p algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import reduce_partials
from cohortspark.functions.columns import q

MAX_P = 2000


@dataclass
class Gram:
    cols: list[str]
    n: float           # Σw
    mean: np.ndarray   # weighted means
    scatter: np.ndarray  # Σw (x-m)(x-m)'  (centred at the exact mean)

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / (self.n - 1)

    @property
    def corr(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.scatter))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.scatter / np.outer(d, d)

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.cols.index(c) for c in names]

    def sub(self, names: Sequence[str]) -> Gram:
        ix = self.index(names)
        return Gram(list(names), self.n, self.mean[ix], self.scatter[np.ix_(ix, ix)])

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        m = (self.n * self.mean + other.n * other.mean) / n
        d1, d2 = self.mean - m, other.mean - m
        s = self.scatter + other.scatter + self.n * np.outer(d1, d1) + other.n * np.outer(d2, d2)
        return Gram(self.cols, n, m, s)

    def __sub__(self, other: Gram) -> Gram:
        """Remove a block (e.g. one fold) from a total."""
        n = self.n - other.n
        m = (self.n * self.mean - other.n * other.mean) / n
        d1, d2 = self.mean - m, other.mean - m
        # second moments of both blocks about the remaining mean m, then subtract
        s = self.scatter + self.n * np.outer(d1, d1) - (other.scatter + other.n * np.outer(d2, d2))
        return Gram(self.cols, n, m, s)


def _partial(cols: list[str], by: list[str], weight: str | None, center: np.ndarray, expand: Callable | None = None):
    p = len(center)

    def fn(batches):
        acc: dict = {}
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64")
            w = pdf[weight].to_numpy(dtype="float64") if weight else np.ones(len(pdf))
            ok = ~np.isnan(x).any(axis=1) & ~np.isnan(w)
            if not ok.any():
                continue
            if by:
                keys = pdf[by[0]].astype(str)
                for b in by[1:]:
                    keys = keys + "\u0001" + pdf[b].astype(str)
            else:
                keys = pd.Series([""] * len(pdf))
            keys = keys[ok].to_numpy()
            xc = (x[ok] if expand is None else expand(x[ok])) - center
            wv = w[ok]
            for k in np.unique(keys):
                sel = keys == k
                xs, ws = xc[sel], wv[sel]
                a = acc.get(k)
                part = (ws.sum(), (ws[:, None] * xs).sum(0), (xs * ws[:, None]).T @ xs)
                acc[k] = part if a is None else (a[0] + part[0], a[1] + part[1], a[2] + part[2])
        for k, (sw, s1, s2) in acc.items():
            yield pd.DataFrame({"k": [k], "sw": [sw], "s1": [s1.tobytes()], "s2": [s2.tobytes()]})
    return fn, p


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None,
         center: np.ndarray | None = None, expand: Callable | None = None, names: Sequence[str] = ()) -> dict[str, Gram]:
    """Per-key Gram over complete rows of ``cols`` (keys joined by U+0001), or of the columns ``names`` that
    ``expand`` makes in the task from a block of them (rows x cols; ``center`` is then near their means)."""
    cols, by = list(cols), list(by)
    if max(len(cols), len(names)) > MAX_P:
        raise ValueError(f"gram supports at most {MAX_P} columns")
    sel = df.select(*[q(c).cast("double").alias(c) for c in cols], *[q(b) for b in by],
                    *([q(weight).cast("double").alias(weight)] if weight else []))
    sel = sel.dropna(subset=cols)
    if center is None:
        row = sel.agg(*[F.avg(c).alias(c) for c in cols]).first()
        center = np.array([row[c] if row[c] is not None else 0.0 for c in cols], dtype="float64")
    fn, p = _partial(cols, by, weight, center, expand)
    parts = sel.mapInPandas(fn, "k string, sw double, s1 binary, s2 binary")

    def to_np(r):
        return (r["k"], (r["sw"], np.frombuffer(r["s1"], dtype="float64"),
                         np.frombuffer(r["s2"], dtype="float64").reshape(p, p)))

    def add(a, b):
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    out = {}
    for k, (sw, s1, s2) in reduce_partials(parts.rdd.map(to_np), add).items():
        if sw <= 0:
            continue
        d = s1 / sw
        mean = center + d
        scatter = s2 - sw * np.outer(d, d)
        out[k] = Gram(list(names) if expand else cols, float(sw), mean, scatter)
    return out


def total(grams: dict[str, Gram]) -> Gram:
    it = iter(grams.values())
    acc = next(it)
    for g in it:
        acc = acc + g
    return acc


# ----------------------------------------------------------- linear algebra

def ols(g: Gram, x: Sequence[str], y: str, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients minimising RSS + alpha * ||b||² (centred)."""
    ix, iy = g.index(x), g.index([y])[0]
    sxx = g.scatter[np.ix_(ix, ix)] + alpha * np.eye(len(ix))
    sxy = g.scatter[ix, iy]
    b = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    a = g.mean[iy] - g.mean[ix] @ b
    return float(a), b


def rss(g: Gram, x: Sequence[str], y: str, a: float, b: np.ndarray) -> float:
    """Σw (y - a - Xb)² of the rows summarised by g, from the Gram alone."""
    ix, iy = g.index(x), g.index([y])[0]
    r_mean = g.mean[iy] - a - g.mean[ix] @ b
    v = np.concatenate([-b, [1.0]])
    sub = g.scatter[np.ix_(ix + [iy], ix + [iy])]
    return float(v @ sub @ v + g.n * r_mean ** 2)
