"""Bootstrap confidence intervals and subgroup metrics (ops 160, 161).

Replicates are never materialised.  Each row carries a Poisson(1)
multiplicity per replicate derived from a 64-bit hash of its key (so the
weights do not depend on partitioning and survive retries); inside each Arrow
batch numpy forms the rows x B weight matrix and reduces it to B partial
sums.  One record per (task, group) leaves each task and ``reduce_partials``
adds them up.

A metric is an object (``Metric``): additive columns and a finisher that turns
their sums into the value, so users bring their own; one whose finisher fails
gives NaN.  A metric that is no function of sums names a value to bin as well:
its finisher gets the weighted histogram of that value inside a bracket and
the sums of what lies below.  The median's bracket holds the middle
BRACKET / sqrt(n) of a group's values, where a replicate's median falls, so its
bins are far finer than its interval; AUC bins the whole score.  Estimates are
exact; replicates of binned metrics are moved by the difference between the
exact and the binned estimate.  Acceleration comes from a grouped
(delete-a-group, JACK hash groups) jackknife of the same sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.aggs import reduce_partials
from cohortspark.functions.columns import q
from cohortspark.functions.quantiles import group_quantiles
from cohortspark.operators import metrics

JACK = 50
OVERALL = "Overall"
BRACKET = 6.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# Levels of an interval are kept inside these limits.
LEVELS = (0.001, 0.999)


@dataclass(frozen=True)
class Metric:
    """``columns(y, prediction, probability)`` are summed per replicate; ``finish(n, *sums)`` gets arrays of the row
    count and of these sums and returns an array.  With ``binned`` (value, side 0 or 1) and ``exact`` the metric is
    finished by ``finish(n, *sums, hist, edges)``, hist[..., side, bin]; see the module."""
    name: str
    columns: Callable[..., list[Column]]
    finish: Callable[..., np.ndarray]
    binned: Callable[..., tuple[Column, Column]] | None = None
    bracketed: bool = False
    exact: Callable[[DataFrame], dict] | None = None  # rows (g, y, p, proba) -> group -> value


def _table() -> np.ndarray:
    """Poisson(1) counts by 16 random bits."""
    upto, p, k = np.zeros(1 << 16, dtype=np.uint8), math.exp(-1), 0
    edge = 0.0
    while edge < 1 - 2.0 ** -17:
        upto[round(edge * 65536):] = k
        edge += p
        k += 1
        p /= k
    return upto


_COUNTS = _table()


def poisson_weights(h: np.ndarray, n_rep: int) -> np.ndarray:
    """rows x B Poisson(1) counts from row hashes (deterministic per row and replicate): four per mixed hash."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64)[:, None] ^ (np.arange(1, -(-n_rep // 4) + 1, dtype=np.uint64) * _GOLD)[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return _COUNTS[np.ascontiguousarray(z).view(np.uint16)][:, :n_rep]


# ------------------------------------------------------------------ metrics

def _median_of(n, below, hist, edges):
    """The value where half the weight is reached, from the weight below the bracket and the bins inside."""
    upto = below[..., None] + np.cumsum(hist[..., 0, :], axis=-1)
    at = (upto < n[..., None] / 2.0).sum(-1)
    return edges[np.minimum(at, len(edges) - 1)]


def _auc_of(n, hist, edges):
    neg, pos = hist[..., 0, :], hist[..., 1, :]
    lower = np.cumsum(neg, axis=-1) - neg
    return (pos * (lower + 0.5 * neg)).sum(-1) / (pos.sum(-1) * neg.sum(-1))


def regression_set() -> list[Metric]:
    def error(y, p):
        return F.abs(y.cast("double") - p.cast("double"))

    def explained(n, e2, y1, y2):
        return 1 - e2 / (y2 - y1 ** 2 / n)

    def medians(rows):
        found = group_quantiles(rows, {"e": error(F.col("y"), F.col("p"))}, [0.5], {"g": F.col("g")})
        return {r["g"]: r["q"][0] for r in found.collect() if r["q"]}

    return [Metric("MAE", lambda y, p, s: [error(y, p)], lambda n, e: e / n),
            Metric("RMSE", lambda y, p, s: [F.pow(error(y, p), 2)], lambda n, e2: np.sqrt(e2 / n)),
            Metric("R2", lambda y, p, s: [F.pow(error(y, p), 2), y.cast("double"), F.pow(y.cast("double"), 2)], explained),
            Metric("MedianAE", lambda y, p, s: [], _median_of, binned=lambda y, p, s: (error(y, p), F.lit(0)),
                   bracketed=True, exact=medians)]


def classification_set(classes: Sequence[str], positive=None) -> list[Metric]:
    """Accuracy and weighted F1; with a positive class (and scores) Brier score and AUC."""
    def agree(y, p, s):
        return [(y.cast("string") == p.cast("string")).cast("double")]

    def cells(y, p, s):
        y, p = y.cast("string"), p.cast("string")
        return [c.cast("double") for k in classes for c in (y == k, p == k, (y == k) & (p == k))]

    def weighted_f1(n, *sums):
        out = 0.0
        for t, p, tp in zip(sums[0::3], sums[1::3], sums[2::3]):
            out = out + t * np.divide(2 * tp, t + p, out=np.zeros_like(t), where=t + p > 0)
        return out / n

    out = [Metric("Accuracy", agree, lambda n, c: c / n), Metric("F1", cells, weighted_f1)]
    if positive is None:
        return out

    def hit(y):
        return (y.cast("string") == F.lit(str(positive))).cast("int")

    def areas(rows):
        found = metrics.roc_auc(rows.withColumnRenamed("proba", "s"), "y", "s", positive, by=["g"])
        return {r["g"]: r["roc_auc"] for r in found.collect()}

    return out + [Metric("Brier", lambda y, p, s: [F.pow(s.cast("double") - hit(y), 2)], lambda n, b: b / n),
                  Metric("AUC", lambda y, p, s: [], _auc_of, binned=lambda y, p, s: (s.cast("double"), hit(y)), exact=areas)]


# ------------------------------------------------------------------ intervals

def bca_intervals(estimate: np.ndarray, boot: np.ndarray, jack: np.ndarray,
                  alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Bias-corrected and accelerated limits (Efron 1987) for all metrics at once: estimate (m), boot (B x m) and jack
    (groups x m); replicates that are not finite are left out.

    level(alpha) = Phi(z0 + u / (1 - a u)), u = z0 + Phi^-1(alpha); z0 = Phi^-1(share of replicates below the
    estimate); a = sum(d^3) / (6 sum(d^2)^(3/2)) with d the jackknife mean less its values."""
    normal = NormalDist()
    phi, inverse = np.vectorize(normal.cdf, otypes=[float]), np.vectorize(normal.inv_cdf, otypes=[float])
    boot = np.where(np.isfinite(boot), boot, np.nan)
    jack = np.where(np.isfinite(jack), jack, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        used = np.isfinite(boot).sum(0)
        below = (boot < estimate).sum(0)
        z0 = inverse(np.clip(below / np.maximum(used, 1), 1 / (used + 1.0), used / (used + 1.0)).clip(1e-12, 1 - 1e-12))
        d = np.nansum(jack, 0) / np.maximum(np.isfinite(jack).sum(0), 1) - jack
        spread = np.nansum(d ** 2, 0)
        a = np.where(spread > 0, np.nansum(d ** 3, 0) / (6 * spread ** 1.5), 0.0)
        u = z0 + inverse(np.array([[alpha / 2], [1 - alpha / 2]]))  # tails x metrics
        shifted = u / (1 - a * u)
        level = np.clip(phi(np.where(np.isfinite(shifted), z0 + shifted, u)), *LEVELS)
    limits = [[np.nanquantile(boot[:, j], level[t, j]) if used[j] else np.nan for j in range(boot.shape[1])] for t in (0, 1)]
    return np.array(limits[0]), np.array(limits[1])


# ------------------------------------------------------------------ sums

def _partials(m: int, binned: int, n_rep: int, bins: int, frames: dict, whole: list[int] | None = None, chunk: int = 512):
    """Per group: sums (B x m) and group sums (JACK x m), histograms (B x 2 x bins) and (JACK x 2 x bins) per binned
    metric.  frames: (group, metric) -> (lo, hi) of its bins.  With ``whole`` also for 'Overall', whose sums are those
    of these columns over all groups: a row's weights are drawn once."""
    def empty(width):
        return [np.zeros((n_rep, width)), np.zeros((JACK, width)),
                np.zeros((binned, n_rep, 2 * bins)), np.zeros((binned, JACK, 2 * bins))]

    def count(hist, jhist, part, here, w, jg, k):
        for b in range(binned):
            lo, hi = frames[(k, b)]
            x, side = part[f"x{b}"].to_numpy(dtype="float64")[here], part[f"s{b}"].to_numpy()[here]
            inside = np.flatnonzero((x >= lo) & (x <= hi))
            if not len(inside):
                continue
            cell = np.minimum((x[inside] - lo) / ((hi - lo) or 1.0) * bins, bins - 1).astype(np.int64)
            cell += bins * side[inside].astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            hist[b][:, cell[first]] += np.add.reduceat(w[inside[order]].astype(np.float64), first, axis=0).T
            np.add.at(jhist[b], (jg[inside[order]], cell), 1.0)

    def fn(batches):
        acc: dict = {}
        every = empty(0)
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at:at + chunk]
                v = part[[f"c{i}" for i in range(m)]].to_numpy(dtype="float64")
                w_all = poisson_weights(part["__h"].to_numpy().astype(np.int64).view(np.uint64), n_rep)
                groups, jg = part["__key"].astype(str).to_numpy(), part["__jg"].to_numpy()
                for k in np.unique(groups):
                    here = np.flatnonzero(groups == k)
                    w, vv = w_all[here], v[here]
                    if k not in acc:
                        acc[k] = empty(m)
                    boot, jack, hist, jhist = acc[k]
                    boot += w.T.astype(np.float64) @ vv
                    np.add.at(jack, jg[here], vv)
                    count(hist, jhist, part, here, w, jg[here], k)
                if whole is not None:
                    count(every[2], every[3], part, slice(None), w_all, jg, OVERALL)
        if whole is not None and acc:
            acc[OVERALL] = [sum(boot[:, whole] for boot, *_rest in acc.values()),
                            sum(jack[:, whole] for _boot, jack, *_rest in acc.values()), *every[2:]]
            acc = {k: [boot[:, :len(whole)], jack[:, :len(whole)], *rest] for k, (boot, jack, *rest) in acc.items()}
        for k, parts in acc.items():
            yield pd.DataFrame({"k": [k], **{n: [p.tobytes()] for n, p in zip(("boot", "jack", "hist", "jhist"), parts)}})
    return fn


def _frames(rows: DataFrame, chosen: list[Metric]) -> dict:
    """(group, binned metric) -> range of its bins: all values, or the middle around the median."""
    steps = [0.5 * 0.75 ** i for i in range(28)]
    probs = [0.5 - s for s in steps] + [0.5 + s for s in reversed(steps)]
    out: dict = {}
    for b, metric in enumerate(chosen):
        x = F.col(f"x{b}")
        found = rows.groupBy("__key").agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                                          F.percentile_approx(x, probs, 4000).alias("s")).collect()
        for r in found:
            if not r["n"]:
                out[(r["__key"], b)] = (0.0, 0.0)
                continue
            lo, hi = r["lo"], r["hi"]
            wanted = BRACKET / 2 / math.sqrt(r["n"]) + 2 / 4000
            fits = [i for i, s in enumerate(steps) if s >= wanted]
            if metric.bracketed and fits:
                lo, hi = r["s"][fits[-1]], r["s"][-1 - fits[-1]]
            out[(r["__key"], b)] = (float(lo), float(hi))
    return out


def _safe(fn: Callable, *args, shape) -> np.ndarray:
    try:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.broadcast_to(np.asarray(fn(*args), dtype=float), shape)
    except Exception:  # a user's metric that fails has no value
        return np.full(shape, np.nan)


def bootstrap_metrics(df: DataFrame, y: str, yhat: str, task: str = "regression", proba: str | None = None,
                      key: Sequence[str] | None = None, n_resamples: int = 1000, ci_level: float = 0.95,
                      seed: int = 42, by: str | None = None, min_group: int = 5, bins: int = 256,
                      positive=1, metrics_: Sequence[Metric] | None = None) -> DataFrame:
    """Estimate and BCa interval for every metric of the task, or for the given ``metrics_``, optionally per
    subgroup plus 'Overall' (op 161: groups below ``min_group`` rows dropped).

    ``key`` identifies a row (its weights follow from it).  Subgroups are reported to the driver with
    n_resamples x (sums + bins) numbers each: for subgroups of people, not for keys of rows."""
    keys = [q(k) for k in (key or df.columns)]
    score = q(proba) if proba is not None else F.lit(None).cast("double")
    base = df.where(q(y).isNotNull() & q(yhat).isNotNull())
    if metrics_ is not None:
        chosen = list(metrics_)
    elif task == "regression":
        chosen = regression_set()
    else:
        found = base.select(F.explode(F.array(q(y).cast("string"), q(yhat).cast("string"))).alias("c")).distinct().collect()
        chosen = classification_set(sorted(r["c"] for r in found), positive if proba is not None else None)
    group = F.coalesce(q(by).cast("string"), F.lit("None")) if by else F.lit(OVERALL)

    def members(own):
        return F.explode(F.array(own, F.lit(OVERALL))) if by else own
    sums = [m.columns(q(y), q(yhat), score) for m in chosen]
    binned = [m for m in chosen if m.binned]
    values = [m.binned(q(y), q(yhat), score) for m in binned]
    jack_group = F.pmod(F.xxhash64(F.lit(seed + 1), *keys), F.lit(JACK)).cast("int")
    flat = [c for cols in sums for c in cols]
    rows = base.select(group.alias("__key"), F.xxhash64(F.lit(seed), *keys).alias("__h"), jack_group.alias("__jg"),
                       *[c.cast("double").alias(f"c{i + 1}") for i, c in enumerate(flat)],
                       *[v.cast("double").alias(f"x{b}") for b, (v, _s) in enumerate(values)],
                       *[s.cast("int").alias(f"s{b}") for b, (_v, s) in enumerate(values)])
    at_all = rows.select(members(F.col("__key")).alias("__key"), *[f"x{b}" for b in range(len(binned))])
    frames = _frames(at_all, binned) if binned else {}
    extra, extra_all = [], []  # what lies below a bracket is one more sum
    for b, metric in enumerate(binned):
        if metric.bracketed:
            below = F.create_map(*[x for (g, i), (lo, _hi) in frames.items() if i == b for x in (F.lit(g), F.lit(lo))]) \
                if frames else F.lit(None)
            extra.append((F.col(f"x{b}") < below[F.col("__key")]).cast("double") if frames else F.lit(0.0))
            extra_all.append((F.col(f"x{b}") < F.lit(frames[(OVERALL, b)][0])).cast("double") if frames else F.lit(0.0))
    m, sums_only = 1 + len(flat) + len(extra), 1 + len(flat)
    whole_columns = [*range(sums_only), *range(m, m + len(extra_all))] if by else None
    ready = rows.select("*", F.lit(1.0).alias("c0"), *[e.alias(f"c{sums_only + i}") for i, e in enumerate(
        [*extra, *(extra_all if by else [])])])
    parts = ready.mapInPandas(_partials(m + (len(extra_all) if by else 0), len(binned), n_resamples, bins, frames, whole_columns),
                              "k string, boot binary, jack binary, hist binary, jhist binary")

    def arrays(r):
        shapes = {"boot": (n_resamples, m), "jack": (JACK, m), "hist": (len(binned), n_resamples, 2, bins),
                  "jhist": (len(binned), JACK, 2, bins)}
        return r["k"], tuple(np.frombuffer(r[n]).reshape(s) for n, s in shapes.items())

    totals = reduce_partials(parts.rdd.map(arrays), lambda a, b: tuple(x + y for x, y in zip(a, b)))
    plain = base.select(members(group).alias("g"), q(y).alias("y"), q(yhat).alias("p"), score.alias("proba"))
    exact = {i: metric.exact(plain) for i, metric in enumerate(chosen) if metric.exact}
    out = []
    for g, (boot, jack, hist, jhist) in totals.items():
        whole, n = jack.sum(0), int(jack[:, 0].sum())
        if by and g != OVERALL and n < min_group:
            continue
        left = whole[None, :] - jack
        est, reps, loo = [], [], []
        at, b, low = 1, 0, 1 + len(flat)
        for i, metric in enumerate(chosen):
            ix = list(range(at, at + len(sums[i])))
            at += len(sums[i])
            tail = []
            if metric.binned:
                lo, hi = frames[(g, b)]
                edges = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
                tail = [(jhist[b].sum(0), edges), (hist[b], edges), (jhist[b].sum(0)[None] - jhist[b], edges)]
                if metric.bracketed:
                    ix.append(low)
                    low += 1
                b += 1
            one, many, out_ = [
                _safe(metric.finish, x[..., 0], *[x[..., j] for j in ix], *(tail[k] if tail else ()), shape=x.shape[:-1])
                for k, x in enumerate((whole, boot, left))]
            move = 0.0
            if metric.exact and exact[i].get(g) is not None and np.isfinite(one):
                move = float(exact[i][g]) - float(one)
            est.append(float(one) + move)
            reps.append(many + move)
            loo.append(out_ + move)
        low_, high = bca_intervals(np.array(est), np.stack(reps, 1), np.stack(loo, 1), 1 - ci_level)
        out += [(g, metric.name, n, e, float(a), float(z), ci_level, n_resamples)
                for metric, e, a, z in zip(chosen, est, low_, high)]
    made = df.sparkSession.createDataFrame(out, "group string, metric string, n long, estimate double, "
                                                "ci_lower double, ci_upper double, ci_level double, n_resamples long")
    return made if by else made.drop("group")
