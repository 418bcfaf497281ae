"""Model registry, fitting, scoring and comparison (ops 126-146).

Linear least-squares models are closed-form from one Gram pass; penalised,
robust, tree, boosting, Bayes and perceptron models are MLlib estimators with
the regularisation scales translated to the original objectives.  Every
fitted model exposes ``transform(df)`` adding ``prediction`` (and
``probability`` for binary classifiers) and works on columns, not on a
driver-side matrix.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.aggs import sum_partials
from cohortspark.functions.columns import is_numeric_type, q
from cohortspark.functions.quantiles import modes
from cohortspark.operators.gram import gram, total
from cohortspark.session import small_batches, written

# --------------------------------------------------------------- fitted models


class FittedModel:
    """Interface: ``name``, ``features``, ``task`` and ``transform``."""

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def coefficients(self) -> dict[str, float] | None:
        return None


@dataclass
class LinearExpr(FittedModel):
    """prediction = a + Σ b_j x_j (or logistic link) as one Column expression."""
    name: str
    features: list[str]
    intercept: float
    coef: list[float]
    task: str = "regression"

    def score(self) -> Column:
        e = F.lit(float(self.intercept))
        for f, b in zip(self.features, self.coef):
            e = e + q(f).cast("double") * F.lit(float(b))
        return e

    def transform(self, df):
        s = self.score()
        if self.task == "regression":
            return df.withColumn("prediction", s)
        p = 1 / (1 + F.exp(-s))
        return df.withColumn("probability", p).withColumn("prediction", (p >= 0.5).cast("double"))

    def coefficients(self):
        return {"(intercept)": self.intercept, **dict(zip(self.features, self.coef))}


@dataclass
class SparkML(FittedModel):
    """Wrapper of a fitted MLlib model over an assembled feature vector."""
    name: str
    features: list[str]
    model: object
    task: str = "regression"
    positive_index: int = 1

    def transform(self, df):
        va = VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep")
        out = self.model.transform(va.transform(df))
        drop = [c for c in ("__features", "rawPrediction") if c in out.columns]
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability")[self.positive_index])
        return out.drop(*drop)

    def coefficients(self):
        m = self.model
        if hasattr(m, "coefficients") and hasattr(m, "intercept"):
            try:
                return {"(intercept)": float(m.intercept), **dict(zip(self.features, m.coefficients.toArray().tolist()))}
            except Exception:  # multinomial
                return None
        return None


@dataclass
class BinnedML(SparkML):
    """Wrapper of a fitted MLlib tree model over the features' bins, numbered from 1; ``splits``: per feature the
    thresholds, a value equal to one belongs to the bin below it, a missing one to the last."""
    splits: list[list[float]] = field(default_factory=list)

    def transform(self, df):
        bins = [f"__bin{i}" for i in range(len(self.features))]
        out = SparkML(self.name, bins, self.model, self.task, self.positive_index).transform(_binned(df, self.features, self.splits))
        return out.drop(*bins)


@dataclass
class CellForest(FittedModel):
    """Regression forest over the features' bins: ``values`` has the mean of all trees for every combination of bins
    (last feature fastest); thresholds and missing values as in ``BinnedML``."""
    name: str
    features: list[str]
    splits: list[list[float]]
    values: np.ndarray
    task: str = "regression"

    def transform(self, df):
        splits, values = self.splits, self.values

        @F.pandas_udf("double")
        def score(*x: pd.Series) -> pd.Series:
            return pd.Series(values[_cell_numbers([v.to_numpy(dtype="float64") for v in x], splits)])

        return df.withColumn("prediction", score(*[q(f).cast("double") for f in self.features]))


@dataclass
class Constant(FittedModel):
    name: str
    features: list[str]
    value: float
    task: str = "regression"

    def transform(self, df):
        return df.withColumn("prediction", F.lit(float(self.value)))


@dataclass
class LDAModel(FittedModel):
    """Linear discriminant: class means + pooled covariance, argmax of scores."""
    name: str
    features: list[str]
    classes: list
    w: np.ndarray       # k x p
    b: np.ndarray       # k
    task: str = "classification"

    def transform(self, df):
        x = ", ".join(f"double(`{f}`)" for f in self.features)

        def score(k):  # SQL text: one call to the JVM a class instead of one a coefficient
            w = ", ".join(f"{float(v)!r}D".upper() for v in self.w[k])
            return f"aggregate(zip_with(array({x}), array({w}), (v, c) -> v * c), {float(self.b[k])!r}D, (a, t) -> a + t)".replace("e+", "E+").replace("e-", "E-")

        scored = df.withColumn("__s", F.expr(f"array({', '.join(score(k) for k in range(len(self.classes)))})"))
        pos = F.array_position("__s", F.array_max("__s")).cast("int")
        out = scored.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), pos))
        if len(self.classes) == 2:
            out = out.withColumn("probability", 1 / (1 + F.exp(-(F.col("__s")[1] - F.col("__s")[0]))))
        return out.drop("__s")


# Numbers in one block of training rows, rows in one block of queries, and in one matrix of distances.
KNN_CELLS = 1 << 20
KNN_QUERIES = 2048
KNN_TILE = (256, 4096)


def _best(d2: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest squared distances of each row and their targets, in no order."""
    if d2.shape[1] <= k:
        return d2, y
    idx = np.argpartition(d2, k - 1, axis=1)[:, :k]
    return np.take_along_axis(d2, idx, 1), np.take_along_axis(y, idx, 1)


def _nearest(x: np.ndarray, tx: np.ndarray, ty: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (rows x at most k) and targets of the training rows nearest to each row of ``x``, in
    tiles: memory does not grow with the rows on either side beyond x k."""
    norms = (tx ** 2).sum(1)
    dist, near = [], []
    for s in range(0, len(x), KNN_TILE[0]):
        xb = x[s:s + KNN_TILE[0]]
        d, yn = np.empty((len(xb), 0)), np.empty((len(xb), 0))
        for t in range(0, len(tx), KNN_TILE[1]):
            tb = slice(t, t + KNN_TILE[1])
            d2 = 2 * xb @ tx[tb].T
            np.subtract((xb ** 2).sum(1)[:, None], d2, out=d2)
            d2 += norms[tb][None, :]
            np.maximum(d2, 0, out=d2)
            if d.shape[1] == k:  # few are nearer than what is held already
                r, c = np.nonzero(d2 < d.max(1)[:, None])
                if len(r):
                    hit = np.unique(r)
                    row = np.concatenate([np.repeat(hit, k), r])
                    dd, yy = np.concatenate([d[hit].ravel(), d2[r, c]]), np.concatenate([yn[hit].ravel(), ty[tb][c]])
                    order = np.lexsort((dd, row))
                    first = np.searchsorted(row[order], hit)
                    keep = order[first[:, None] + np.arange(k)]
                    d[hit], yn[hit] = dd[keep], yy[keep]
                continue
            found = _best(d2, np.broadcast_to(ty[tb], d2.shape), k)
            d, yn = found if t == 0 else _best(np.hstack([d, found[0]]), np.hstack([yn, found[1]]), k)
        dist.append(d)
        near.append(yn)
    return (np.vstack(dist), np.vstack(near)) if dist else (np.empty((0, 0)), np.empty((0, 0)))


def _decide(d2: np.ndarray, yn: np.ndarray, weights: str, task: str) -> np.ndarray:
    """Mean or vote of the neighbours; of classes with equal votes the smallest."""
    w = np.ones_like(d2) if weights == "uniform" else 1.0 / np.maximum(np.sqrt(d2), 1e-12)
    if task == "regression":
        return (w * yn).sum(1) / w.sum(1)
    cls = np.unique(yn)
    votes = np.stack([(w * (yn == c)).sum(1) for c in cls], 1)
    return cls[np.argmax(votes, 1)]


def _blocks(rows: DataFrame, features: Sequence[str], extra: str, size: int, name: str) -> DataFrame:
    """Rows packed into blocks of at most ``size``: id, x (row by row) and the column ``extra`` as bytes, written."""
    feats = list(features)
    kind = "int64" if extra == "__row" else "float64"

    def pack(batches):
        held, n = [], 0

        def block():
            pdf = pd.concat(held)
            return pd.DataFrame({"x": [pdf[feats].to_numpy(dtype="float64").tobytes()], "v": [pdf[extra].to_numpy(dtype=kind).tobytes()]})

        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size]
                if held and n + len(part) > size:
                    yield block()
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield block()

    sel = rows.select(*[q(f).cast("double").alias(f) for f in feats], q(extra).alias(extra))
    packed = sel.mapInPandas(pack, "x binary, v binary")
    return written(packed.withColumn("id", F.monotonically_increasing_id()), name)


@dataclass
class KNNModel(FittedModel):
    """Exact k-NN.  A small training set (arrays) is shipped to every task; a larger one is a written table of
    blocks, each block of query rows meets each of them in a cartesian product, and the k nearest of each pair of
    blocks are merged per block of queries.  Distances are numpy tiles; no pair of rows ever becomes a Spark row."""
    name: str
    features: list[str]
    train_x: np.ndarray | None
    train_y: np.ndarray | None
    k: int = 5
    weights: str = "uniform"
    task: str = "regression"
    train: DataFrame | None = None  # blocks

    def transform(self, df):
        if self.train is not None:
            return self._joined(df)
        spark = df.sparkSession
        bx = spark.sparkContext.broadcast(self.train_x)
        by = spark.sparkContext.broadcast(self.train_y)
        feats, k, weights, task = self.features, self.k, self.weights, self.task
        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])

        def fn(batches):
            tx, ty = bx.value, by.value
            for pdf in batches:
                out = pdf.copy()
                x = pdf[feats].to_numpy(dtype="float64")
                out["prediction"] = _decide(*_nearest(x, tx, ty, k), weights, task) if len(x) else np.empty(0)
                yield out
        return df.mapInPandas(fn, schema)

    def _joined(self, df):
        feats, k, weights, task, p = self.features, self.k, self.weights, self.task, len(self.features)
        small_batches(df.sparkSession)
        rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "knn-rows")
        queries = _blocks(rows, feats, "__row", KNN_QUERIES, "knn-queries")
        pairs = queries.select("id", "x").crossJoin(self.train.select(F.col("x").alias("tx"), F.col("v").alias("ty")))

        def nearest(batches):
            for pdf in batches:
                for i, x, tx, ty in zip(pdf["id"], pdf["x"], pdf["tx"], pdf["ty"]):
                    d2, yn = _nearest(np.frombuffer(x).reshape(-1, p), np.frombuffer(tx).reshape(-1, p), np.frombuffer(ty), k)
                    yield pd.DataFrame({"id": [i], "d": [d2.tobytes()], "y": [yn.tobytes()], "n": [len(d2)]})

        def merge(key, pdf):
            n = int(pdf["n"].iloc[0])
            d2, yn = (np.hstack([np.frombuffer(b).reshape(n, -1) for b in pdf[c]]) for c in ("d", "y"))
            return pd.DataFrame({"id": [key[0]], "p": [_decide(*_best(d2, yn, k), weights, task).tobytes()]})

        def unpack(batches):
            for pdf in batches:
                for v, pred in zip(pdf["v"], pdf["p"]):
                    yield pd.DataFrame({"__row": np.frombuffer(v, dtype="int64"), "prediction": np.frombuffer(pred)})

        near = pairs.mapInPandas(nearest, "id long, d binary, y binary, n long")
        decided = near.groupBy("id").applyInPandas(merge, "id long, p binary")
        preds = queries.select("id", "v").join(decided, "id").select("v", "p").mapInPandas(unpack, "__row long, prediction double")
        return rows.join(preds, "__row").select(*[q(c) for c in df.columns], "prediction")


# ------------------------------------------------------------------ fitters

def _assemble(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Model matrix for an iterative MLlib fit, persisted (memory, spilling to
    disk) so each optimiser pass does not recompute the upstream plan; lost
    blocks are recomputed from lineage.  ``_fit`` releases it afterwards."""
    from pyspark import StorageLevel
    va = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")
    t = va.transform(df.where(q(label).isNotNull()).select(*[q(c).cast("double").alias(c) for c in features],
                                                          q(label).cast("double").alias("__label")))
    return t.select("__features", "__label").persist(StorageLevel.MEMORY_AND_DISK)


def _fit(estimator, data: DataFrame):
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


def fit_ols(df, features, label, alpha: float = 0.0, name: str = "ols") -> LinearExpr:
    """OLS / ridge (RSS + alpha ||b||²) from one Gram pass (ops 126, 127)."""
    return _least_squares(total(gram(df, list(features) + [label])), features, alpha, name)


def _least_squares(g, features, alpha: float, name: str) -> LinearExpr:
    ix = list(range(len(features)))
    sxx = g.scatter[np.ix_(ix, ix)] + alpha * np.eye(len(ix))
    b = np.linalg.lstsq(sxx, g.scatter[ix, len(ix)], rcond=None)[0]
    a = float(g.mean[len(ix)] - g.mean[ix] @ b)
    return LinearExpr(name, list(features), a, [float(v) for v in b])


# Fixed values of MLlib's trees: bins of a feature, rows from which thresholds are found; and joint bins kept as a table,
# joint bins x trees summed in one pass over the rows, and rows x trees weighted at once.
TREE_BINS = 32
TREE_ROWS = 10_000
TREE_CELLS = 1 << 16
BAG_CELLS = 1 << 21
BAG_WEIGHTS = 1 << 20


def _thresholds(counts: dict[float, float], wanted: float, bins: int) -> list[float]:
    """MLlib's thresholds of a continuous feature from the counts of its values other than 0 among about ``wanted``
    rows: the rest counts as 0; midpoints of values next to each other, all or about equally many rows apart."""
    rest = wanted - sum(counts.values())
    if counts and rest > np.finfo(float).eps * sum(counts.values()) * 100:
        counts = {**counts, 0.0: rest}
    at = sorted(counts)
    mid = [(a + b) / 2.0 for a, b in zip(at, at[1:])]
    if len(mid) <= bins - 1:
        return mid
    out, stride, upto = [], wanted / bins, counts[at[0]]
    target = stride
    for m, value in zip(mid, at[1:]):
        before, upto = upto, upto + counts[value]
        if abs(before - target) < abs(upto - target):
            out.append(m)
            target += stride
    return out


def _tree_splits(rows: DataFrame, p: int, n: int, seed: int) -> list[list[float]]:
    """Thresholds of the features x0, x1, ... as MLlib's trees find them: from all rows up to TREE_ROWS, else from the
    rows it draws (same seed and partitions, hence the same bins).  All rows are used in the fit itself."""
    spark = rows.sparkSession
    share = min(1.0, TREE_ROWS / n)
    if share < 1.0:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = rows._jdf.toJavaRDD().sample(False, share, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    seen = rows.select(F.posexplode(F.array(*[f"x{i}" for i in range(p)])).alias("i", "x")).where("x <> 0")
    counts: list[dict[float, float]] = [{} for _ in range(p)]
    for r in seen.groupBy("i", "x").count().collect():  # values of TREE_ROWS rows or so
        counts[r["i"]][r["x"]] = float(r["count"])
    return [_thresholds(c, share * n, min(TREE_BINS, n)) for c in counts]


def _binned(df: DataFrame, features: Sequence[str], splits: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with __bin0, __bin1, ...: the number (from 1) of each feature's bin."""
    from pyspark.ml.feature import Bucketizer
    names = [f"__bin{i}" for i in range(len(features))]
    out = df.select("*", *[q(f).cast("double").alias(c) for f, c in zip(features, names)])
    cut = [(c, [-math.inf, *[math.nextafter(t, math.inf) for t in s], math.inf]) for c, s in zip(names, splits) if s]
    if cut:
        b = Bucketizer(splitsArray=[s for _c, s in cut], inputCols=[c for c, _s in cut], outputCols=[f"{c}b" for c, _s in cut],
                       handleInvalid="keep")
        out = b.transform(out)
    kept = {c for c, _s in cut}
    return out.select(*[q(c) for c in df.columns],
                      *[(q(f"{c}b") + 1 if c in kept else F.lit(1.0)).alias(c) for c in names])


def _tree_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The complete rows as x0, x1, ... and __label, persisted; the caller releases them."""
    from pyspark import StorageLevel
    rows = df.where(q(label).isNotNull()).select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                                                 q(label).cast("double").alias("__label"))
    return rows.where(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(features)))).persist(
        StorageLevel.MEMORY_AND_DISK)


def _tree_bins(rows: DataFrame, p: int, seed: int) -> list[list[float]] | None:
    """Thresholds of the features; None without rows or with too many combinations of bins to be worth it."""
    n = rows.count()
    if n == 0:
        return None
    splits = _tree_splits(rows, p, n, seed)
    return None if math.prod(len(s) + 1 for s in splits) > TREE_CELLS else splits


def _cells(df: DataFrame, features: Sequence[str], label: str, seed: int) -> tuple[DataFrame, list[list[float]]] | None:
    """What a regression tree without row sampling needs of all rows, per combination of bins (written; __features,
    __label, __weight), and the bins' thresholds: two labels, mean - sd and mean + sd, each with half of the rows'
    weight, have the rows' count, sum and sum of squares, and so have the residuals of later trees.  Impurities,
    gains and means follow from these alone.  None if there may be too many combinations to be worth it."""
    p = len(features)
    rows = _tree_rows(df, features, label)
    try:
        if (splits := _tree_bins(rows, p, seed)) is None:
            return None
        names = [f"__bin{i}" for i in range(p)]
        cells = _binned(rows, [f"x{i}" for i in range(p)], splits).groupBy(*names).agg(
            F.avg("__label").alias("m"), F.stddev_pop("__label").alias("s"), F.count(F.lit(1)).alias("n"))
        cells = cells.select(*names, F.expr("explode(if(s = 0, array(m), array(m - s, m + s)))").alias("__label"),
                             F.expr("if(s = 0, n, n / 2)").cast("double").alias("__weight"))
        cells = VectorAssembler(inputCols=names, outputCol="__features").transform(written(cells, "tree-cells"))
    finally:
        rows.unpersist()
    return cells.select("__features", "__label", "__weight"), splits


def _cell_numbers(x: Sequence[np.ndarray], splits: Sequence[Sequence[float]]) -> np.ndarray:
    """The combination of bins of each row, from 0; a value equal to a threshold is below it, a missing one last."""
    at = np.zeros(len(x[0]), dtype="int64")
    for v, s in zip(x, splits):
        at = at * (len(s) + 1) + np.searchsorted(np.asarray(s, dtype="float64"), v, side="left")
    return at


def _bag_sums(splits: Sequence[Sequence[float]], trees: range, center: float) -> Callable:
    """For mapInPandas: per tree, the drawn rows and the sum of their labels less ``center`` in every combination of
    bins.  Each row is drawn a Poisson(1) number of times for each tree."""
    from cohortspark.operators.resample import poisson_weights
    n_cells, step = math.prod(len(s) + 1 for s in splits), max(1, BAG_WEIGHTS // len(trees))

    def fn(batches):
        n, total = np.zeros((len(trees), n_cells)), np.zeros((len(trees), n_cells))
        for pdf in batches:
            cell = _cell_numbers([pdf[f"x{i}"].to_numpy(dtype="float64") for i in range(len(splits))], splits)
            h, y = pdf["__h"].to_numpy(dtype="int64"), pdf["__label"].to_numpy(dtype="float64") - center
            for a in range(0, len(cell), step):
                c, yc = cell[a:a + step], y[a:a + step]
                for j, w in enumerate(np.ascontiguousarray(poisson_weights(h[a:a + step], len(trees)).T)):
                    n[j] += np.bincount(c, w, n_cells)
                    total[j] += np.bincount(c, w * yc, n_cells)
        for j, tree in enumerate(trees if n.any() else ()):
            yield pd.DataFrame({"tree": [tree], "n": [n[j].tobytes()], "s": [total[j].tobytes()]})
    return fn


def _grow(n: np.ndarray, s: np.ndarray, bins: Sequence[int], per_node: int, max_depth: int, min_leaf: int, rng) -> np.ndarray:
    """The prediction of MLlib's regression tree for every combination of bins, from the drawn rows ``n`` and label
    sums ``s`` in them: at each node the best split of ``per_node`` features drawn for it, a leaf where none of them
    lowers the squared error.  A node is a box of combinations."""
    axes = [i for i, m in enumerate(bins) if m > 1]
    axis_of = {f: j for j, f in enumerate(axes)}
    n, s = (v.reshape([bins[i] for i in axes]) for v in (n, s))
    out = np.empty(s.shape)
    todo = [(tuple(slice(0, bins[i]) for i in axes), 0)]
    while todo:
        box, depth = todo.pop()
        nb, sb = n[box], s[box]
        rows, total = int(nb.sum()), float(sb.sum())
        best, cut = 0.0, None
        for f in (sorted(rng.permutation(len(bins))[:per_node]) if depth < max_depth and rows >= 2 * min_leaf else ()):
            j = axis_of.get(int(f))
            if j is None or nb.shape[j] < 2:
                continue
            others = tuple(a for a in range(nb.ndim) if a != j)
            left, ls = np.cumsum(nb.sum(others))[:-1], np.cumsum(sb.sum(others))[:-1]
            ok = np.flatnonzero((left >= min_leaf) & (rows - left >= min_leaf))
            if not len(ok):
                continue
            left, ls = left[ok], ls[ok]
            gain = ls * ls / left + (total - ls) ** 2 / (rows - left) - total * total / rows
            k = int(gain.argmax())
            if gain[k] > best:
                best, cut = gain[k], (j, box[j].start + int(ok[k]) + 1)
        if cut is None:
            out[box] = total / rows if rows else 0.0
            continue
        j, at = cut
        todo.append((box[:j] + (slice(at, box[j].stop),) + box[j + 1:], depth + 1))
        todo.append((box[:j] + (slice(box[j].start, at),) + box[j + 1:], depth + 1))
    return out.ravel()


def _fit_cell_forest(df, features, label, n_trees: int, max_depth: int, min_leaf: int, seed: int, name: str) -> CellForest | None:
    """All trees of a bagged regression forest from one pass over the rows: what a tree needs of its drawn rows is
    their count and label sum per combination of bins.  Tasks add these up, then each tree is grown in a task of its
    own.  Bins, features a node tries and stopping rules are MLlib's; draws are numbered rows', as MLlib's are.  None
    if there may be too many combinations."""
    p = len(features)
    rows = _tree_rows(df, features, label)
    try:
        splits = _tree_bins(rows, p, seed)
        center = rows.agg(F.avg("__label")).first()[0] if splits is not None else None
        if center is None or not math.isfinite(center):  # MLlib refuses such labels
            return None
        bins = [len(s) + 1 for s in splits]
        per_node, min_leaf = p if n_trees == 1 else -(-p // 3), max(min_leaf, 1)
        step = max(1, BAG_CELLS // math.prod(bins))

        def to_np(r):
            return r["tree"], (np.frombuffer(r["n"]), np.frombuffer(r["s"]))

        def add(a, b):
            return a[0] + b[0], a[1] + b[1]

        def grow(kv):
            return kv[0], _grow(*kv[1], bins, per_node, max_depth, min_leaf, np.random.default_rng([seed & (2 ** 64 - 1), kv[0]]))

        values = np.zeros(math.prod(bins))
        for at in range(0, n_trees, step):
            trees = range(at, min(at + step, n_trees))
            drawn = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.lit(at), F.monotonically_increasing_id()))
            parts = drawn.mapInPandas(_bag_sums(splits, trees, center), "tree long, n binary, s binary")
            for _tree, v in sorted(sum_partials(parts.rdd.map(to_np), add).map(grow).collect(), key=lambda kv: kv[0]):
                values += v
    finally:
        rows.unpersist()
    return CellForest(name, list(features), splits, values / n_trees + center)


def _pop_sd(df, label) -> float:
    return float(df.agg(F.stddev_pop(q(label).cast("double"))).first()[0] or 1.0)


def fit_elastic(df, features, label, alpha: float = 1.0, l1_ratio: float = 0.5, name: str = "elasticnet",
                max_iter: int = 1000) -> SparkML:
    """Lasso / elastic net (ops 128, 129): RSS/2n + α·l1·|b|₁ + α(1-l1)/2·|b|²
    maps to MLlib with the L2 part scaled by the population sd of y."""
    from pyspark.ml.regression import LinearRegression
    a1 = alpha * l1_ratio
    a2 = alpha * (1 - l1_ratio) * _pop_sd(df, label)
    reg = a1 + a2
    en = a1 / reg if reg > 0 else 0.0
    m = _fit(LinearRegression(featuresCol="__features", labelCol="__label", regParam=reg, elasticNetParam=en,
                         standardization=False, maxIter=max_iter), _assemble(df, features, label))
    return SparkML(name, list(features), m)


def fit_logistic(df, features, label, C: float = 1.0, penalty: str = "l2", name: str = "logreg",
                 max_iter: int = 1000) -> SparkML:
    """Logistic regression with C (ops 126, 130): regParam = 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression
    t = _assemble(df, features, label)
    n = t.count()
    m = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=1.0 / (C * n),
                           elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
                           maxIter=max_iter).fit(t)
    t.unpersist()
    return SparkML(name, list(features), m, "classification")


def fit_huber(df, features, label, epsilon: float = 1.35, alpha: float = 0.0, name: str = "huber") -> SparkML:
    from pyspark.ml.regression import LinearRegression
    t = _assemble(df, features, label)
    n = t.count()
    m = LinearRegression(featuresCol="__features", labelCol="__label", loss="huber", epsilon=epsilon,
                         regParam=alpha / n, standardization=False).fit(t)
    t.unpersist()
    return SparkML(name, list(features), m)


def fit_forest(df, features, label, task="regression", n_trees: int = 100, max_depth: int = 30,
               min_leaf: int = 1, bootstrap: bool = True, seed: int = 42, name: str = "rf",
               cells: bool = False) -> FittedModel:
    """Random forest; ``bootstrap=False`` with sqrt features is the declared
    stand-in for extremely randomised trees (ops 132, 133).  Regression without
    row sampling is fitted on counts and means per combination of bins; with
    ``cells`` so is regression on bootstrap rows, with other draws than MLlib's."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    if cells and task == "regression" and bootstrap and (
            forest := _fit_cell_forest(df, features, label, n_trees, min(max_depth, 30), min_leaf, seed, name)):
        return forest
    if task == "regression" and not bootstrap and min_leaf <= 1 and (found := _cells(df, features, label, seed)):
        cells, splits = found
        m = RandomForestRegressor(featuresCol="__features", labelCol="__label", weightCol="__weight", numTrees=n_trees,
                                  maxDepth=min(max_depth, 30), bootstrap=False, seed=seed, maxBins=TREE_BINS,
                                  featureSubsetStrategy="sqrt").fit(cells)
        return BinnedML(name, list(features), m, task, splits=splits)
    cls = RandomForestRegressor if task == "regression" else RandomForestClassifier
    m = _fit(cls(featuresCol="__features", labelCol="__label", numTrees=n_trees, maxDepth=min(max_depth, 30),
            minInstancesPerNode=min_leaf, bootstrap=bootstrap, seed=seed,
            featureSubsetStrategy="auto" if bootstrap else "sqrt"), _assemble(df, features, label))
    return SparkML(name, list(features), m, task)


def fit_boosting(df, features, label, task="regression", max_depth: int = 3, step: float = 0.1,
                 rounds: int = 100, seed: int = 42, name: str = "histgb") -> SparkML:
    """Gradient-boosted trees (op 134); multiclass via one-vs-rest.  Regression
    is fitted on counts and means per combination of bins."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.regression import GBTRegressor
    if task == "regression" and (found := _cells(df, features, label, seed)):
        cells, splits = found
        m = GBTRegressor(featuresCol="__features", labelCol="__label", weightCol="__weight", maxDepth=max_depth,
                         stepSize=step, maxIter=rounds, seed=seed, maxBins=TREE_BINS).fit(cells)
        return BinnedML(name, list(features), m, task, splits=splits)
    t = _assemble(df, features, label)
    if task == "regression":
        m = GBTRegressor(featuresCol="__features", labelCol="__label", maxDepth=max_depth, stepSize=step,
                         maxIter=rounds, seed=seed).fit(t)
    else:
        k = t.select("__label").distinct().count()
        est = GBTClassifier(featuresCol="__features", labelCol="__label", maxDepth=max_depth, stepSize=step,
                            maxIter=rounds, seed=seed)
        m = est.fit(t) if k <= 2 else OneVsRest(classifier=est, featuresCol="__features", labelCol="__label").fit(t)
    t.unpersist()
    return SparkML(name, list(features), m, task)


def fit_naive_bayes(df, features, label, name: str = "gaussian_nb") -> SparkML:
    from pyspark.ml.classification import NaiveBayes
    m = _fit(NaiveBayes(featuresCol="__features", labelCol="__label", modelType="gaussian"), _assemble(df, features, label))
    return SparkML(name, list(features), m, "classification")


def fit_mlp(df, features, label, hidden: Sequence[int] = (32, 32), seed: int = 42, max_iter: int = 200,
            name: str = "nn") -> SparkML:
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    t = _assemble(df, features, label)
    k = int(t.agg(F.max("__label")).first()[0]) + 1
    m = MultilayerPerceptronClassifier(featuresCol="__features", labelCol="__label",
                                       layers=[len(features), *hidden, max(k, 2)], seed=seed, maxIter=max_iter).fit(t)
    t.unpersist()
    return SparkML(name, list(features), m, "classification")


def fit_linear_svc(df, features, label, C: float = 1.0, name: str = "svc", max_iter: int = 100) -> SparkML:
    from pyspark.ml.classification import LinearSVC
    t = _assemble(df, features, label)
    n = t.count()
    m = LinearSVC(featuresCol="__features", labelCol="__label", regParam=1.0 / (C * n), maxIter=max_iter).fit(t)
    t.unpersist()
    return SparkML(name, list(features), m, "classification")


def fit_lda(df, features, label, name: str = "lda") -> LDAModel:
    """Class means and pooled covariance from one Gram pass keyed by class (op 138)."""
    gs = gram(df.where(q(label).isNotNull()), list(features), by=[label])
    numbers = is_numeric_type(df.schema[label].dataType)
    classes = sorted(gs, key=float if numbers else str)
    n = sum(gs[c].n for c in classes)
    pooled = sum(gs[c].scatter for c in classes) / (n - len(classes))
    inv = np.linalg.pinv(pooled)
    w = np.array([inv @ gs[c].mean for c in classes])
    b = np.array([-0.5 * gs[c].mean @ inv @ gs[c].mean + math.log(gs[c].n / n) for c in classes])
    return LDAModel(name, list(features), [float(c) if numbers else str(c) for c in classes], w, b)


def fit_knn(df, features, label, k: int = 5, weights: str = "uniform", task: str = "regression",
            broadcast_cells: int = 2_000_000, name: str = "knn") -> KNNModel:
    """Exact k-NN with any number of training rows: up to ``broadcast_cells`` (rows x features) they are arrays
    of the model, beyond that a written table of blocks that never passes the driver."""
    feats = list(features)
    t = df.where(q(label).isNotNull()).select(*[q(c).cast("double") for c in feats], q(label).cast("double").alias("__y")).dropna()
    n = t.count()
    k = min(k, max(n - 1, 1))
    if n * len(feats) > broadcast_cells:
        small_batches(df.sparkSession)
        size = max(1, min(1 << 16, KNN_CELLS // max(len(feats), 1)))
        return KNNModel(name, feats, None, None, k, weights, task, _blocks(t, feats, "__y", size, "knn-train"))
    pdf = t.toPandas()  # size-checked above
    return KNNModel(name, feats, pdf[feats].to_numpy(), pdf["__y"].to_numpy(), k, weights, task)


def fit_mean(df, features, label, name: str = "Baseline: Mean") -> Constant:
    return Constant(name, list(features), float(df.agg(F.avg(q(label).cast("double"))).first()[0]))


def fit_majority(df, features, label, name: str = "Baseline: Majority") -> Constant:
    v = modes(df, {"y": q(label).cast("double")})["y"]
    return Constant(name, list(features), float(v), "classification")


# ------------------------------------------------------------------ registry (ops 126-139)

@dataclass
class ModelSpec:
    key: str
    task: str          # regression | classification | both
    fit: Callable
    defaults: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)   # hyperparameter ranges (lo, hi, log) or choices
    needs_scaling: bool = False


# Registry keys, default hyperparameters and search ranges.
REGISTRY: dict[str, ModelSpec] = {
    "ridge": ModelSpec("ridge", "regression", lambda d, f, y, **p: fit_ols(d, f, y, p.get("alpha", 1.0), "ridge"),
                       {"alpha": 1.0}, {"alpha": (0.01, 100.0, True)}, True),
    "lasso": ModelSpec("lasso", "regression",
                       lambda d, f, y, **p: fit_elastic(d, f, y, p.get("alpha", 1.0), 1.0, "lasso"),
                       {"alpha": 1.0}, {"alpha": (0.01, 100.0, True)}, True),
    "elasticnet": ModelSpec("elasticnet", "regression",
                            lambda d, f, y, **p: fit_elastic(d, f, y, p.get("alpha", 1.0), p.get("l1_ratio", 0.5)),
                            {"alpha": 1.0, "l1_ratio": 0.5}, {"alpha": (0.01, 100.0, True), "l1_ratio": (0.0, 1.0, False)}, True),
    "logreg": ModelSpec("logreg", "classification",
                        lambda d, f, y, **p: fit_logistic(d, f, y, p.get("C", 1.0), p.get("penalty", "l2")),
                        {"C": 1.0, "penalty": "l2"}, {"C": (0.01, 100.0, True), "penalty": ["l2", "l1"]}, True),
    "glm": ModelSpec("glm", "both", None, {}, {}, True),
    "huber": ModelSpec("huber", "regression",
                       lambda d, f, y, **p: fit_huber(d, f, y, p.get("epsilon", 1.35), p.get("alpha", 0.0)),
                       {"epsilon": 1.35, "alpha": 0.0}, {"epsilon": (1.0, 3.0, False), "alpha": (0.0001, 1.0, True)}, True),
    "rf": ModelSpec("rf", "both", None, {"n_trees": 100, "max_depth": 30, "min_leaf": 1},
                    {"n_trees": (50, 500, False), "max_depth": (3, 30, False), "min_leaf": (1, 20, False)}),
    "extratrees": ModelSpec("extratrees", "both", None, {"n_trees": 100}, {"n_trees": (50, 500, False)}),
    "histgb": ModelSpec("histgb", "both", None, {"max_depth": 3, "step": 0.1, "rounds": 100},
                        {"max_depth": (2, 8, False), "step": (0.01, 0.3, True), "rounds": (50, 300, False)}),
    "knn": ModelSpec("knn", "both", None, {"k": 5, "weights": "uniform"},
                     {"k": (1, 50, False), "weights": ["uniform", "distance"]}, True),
    "svc": ModelSpec("svc", "classification", lambda d, f, y, **p: fit_linear_svc(d, f, y, p.get("C", 1.0), max_iter=p.get("max_iter", 100)),
                     {"C": 1.0}, {"C": (0.01, 100.0, True)}, True),
    "svc_rbf": ModelSpec("svc_rbf", "classification",
                         lambda d, f, y, **p: fit_rbf_svm(d, f, y, "classification", p.get("C", 1.0),
                                                          max_iter=p.get("max_iter", 100)),
                         {"C": 1.0}, {"C": (0.01, 100.0, True)}, True),
    "svr": ModelSpec("svr", "regression", lambda d, f, y, **p: fit_rbf_svm(d, f, y, "regression", p.get("C", 1.0)),
                     {"C": 1.0}, {"C": (0.01, 100.0, True)}, True),
    "gaussian_nb": ModelSpec("gaussian_nb", "classification", lambda d, f, y, **p: fit_naive_bayes(d, f, y)),
    "lda": ModelSpec("lda", "classification", lambda d, f, y, **p: fit_lda(d, f, y), {}, {}, True),
    "nn": ModelSpec("nn", "classification", lambda d, f, y, **p: fit_mlp(d, f, y), {}, {}, True),
}


def fit_model(key: str, df: DataFrame, features: Sequence[str], label: str, task: str, **params) -> FittedModel:
    spec = REGISTRY[key]
    p = {**spec.defaults, **params}
    if key == "glm":
        return fit_ols(df, features, label, 0.0, "glm") if task == "regression" else \
            fit_logistic(df, features, label, 1.0, "l2", "glm")
    if key == "rf":
        return fit_forest(df, features, label, task, p["n_trees"], p["max_depth"], p["min_leaf"], True, name="rf")
    if key == "extratrees":
        return fit_forest(df, features, label, task, p["n_trees"], p.get("max_depth", 30), 1, False, name="extratrees")
    if key == "histgb":
        return fit_boosting(df, features, label, task, p["max_depth"], p["step"], p["rounds"], name="histgb")
    if key == "knn":
        return fit_knn(df, features, label, p["k"], p["weights"], task)
    return spec.fit(df, list(features), label, **p)


# -------------------------------------------------------- metrics on predictions

def score_model(model: FittedModel, test: DataFrame, label: str, task: str) -> dict[str, float]:
    from cohortspark.operators import metrics as mt
    pred = model.transform(test).where(q(label).isNotNull())
    # every metric reads the predictions: written once, without the plan that made them
    pred = written(pred.select(label, *[c for c in ("prediction", "probability") if c in pred.columns]), "predictions")
    if task == "regression":
        return mt.regression_metrics(pred, label, "prediction").first().asDict()
    out = mt.accuracy_f1(pred, label, "prediction").first().asDict()
    if "probability" in pred.columns:
        out["roc_auc"] = mt.roc_auc(pred, label, "probability").first()["roc_auc"]
    return out


def weighted_huber_loss(y_pred: Column, y_true: Column, t0: float = 180.0, s: float = 20.0,
                        alpha: float = 2.5, delta: float = 1.0) -> Column:
    """Per-row weighted Huber term (op 140); average it with ``F.avg``."""
    w = F.least(F.greatest(1 + alpha * F.exp(-F.pow((y_true - t0) / s, 2)), F.lit(0.1)), F.lit(10.0))
    r = F.abs(y_pred - y_true)
    h = F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))
    return w * h


def baselines(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, task: str) -> list[FittedModel]:
    """Mean / majority null model plus OLS / logistic (op 141)."""
    if task == "regression":
        return [fit_mean(train, features, label), fit_ols(train, features, label, 0.0, "Baseline: Linear")]
    return [fit_majority(train, features, label), fit_logistic(train, features, label, 1.0, "l2", "Baseline: Logistic")]


def fit_all(keys: Sequence[str], train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
            task: str, params: Mapping[str, dict] | None = None) -> DataFrame:
    """Train several registry models, score on test, rank (op 144): RMSE
    ascending for regression, accuracy descending for classification."""
    rows = []
    for k in keys:
        m = fit_model(k, train, features, label, task, **(params or {}).get(k, {}))
        sc = score_model(m, test, label, task)
        rows.append((k, *[float(sc[c]) if sc.get(c) is not None else None for c in _metric_cols(task)]))
    spark = train.sparkSession
    cols = _metric_cols(task)
    df = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in cols))
    from pyspark.sql import Window
    order = F.asc("rmse") if task == "regression" else F.desc("accuracy")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, F.asc("model"))))


def _metric_cols(task):
    return ["mae", "rmse", "r2", "median_ae"] if task == "regression" else ["accuracy", "f1_weighted", "roc_auc"]


def random_search(key: str, train: DataFrame, val: DataFrame, features: Sequence[str], label: str, task: str,
                  trials: int = 30, seed: int = 42) -> DataFrame:
    """Random search over the registry ranges, scored on validation RMSE (or
    error rate) (op 143).  One row per trial."""
    rng = random.Random(seed)
    space = REGISTRY[key].space
    rows = []
    for t in range(trials):
        p = {}
        for name, rg in space.items():
            if isinstance(rg, list):
                p[name] = rng.choice(rg)
            else:
                lo, hi, log = rg
                v = math.exp(rng.uniform(math.log(lo), math.log(hi))) if log else rng.uniform(lo, hi)
                p[name] = int(round(v)) if isinstance(lo, int) and isinstance(hi, int) else v
        m = fit_model(key, train, features, label, task, **p)
        sc = score_model(m, val, label, task)
        obj = sc["rmse"] if task == "regression" else 1 - sc["accuracy"]
        rows.append((t, str(p), float(obj)))
    return train.sparkSession.createDataFrame(rows, "trial long, params string, objective double")


def coefficient_table(model: FittedModel) -> DataFrame | None:
    """Intercept first, then features by |b| descending (op 145)."""
    c = model.coefficients()
    if c is None:
        return None
    items = [("(intercept)", c["(intercept)"], 0)] + sorted(
        [(k, v, 1) for k, v in c.items() if k != "(intercept)"], key=lambda t: -abs(t[1]))
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(k, float(v), i) for i, (k, v, _o) in enumerate(items)],
                                 "term string, coefficient double, position long")


def external_validation(model: FittedModel, external: DataFrame, label: str, task: str,
                        n_resamples: int = 500, key: Sequence[str] | None = None) -> DataFrame:
    """Check required columns, apply the model, report metrics with BCa intervals (op 146)."""
    missing = [c for c in model.features + [label] if c not in external.columns]
    if missing:
        raise ValueError(f"external data lacks columns {missing}")
    from cohortspark.operators.resample import bootstrap_metrics
    pred = model.transform(external)
    return bootstrap_metrics(pred, label, "prediction", task, "probability" if "probability" in pred.columns else None,
                             key=key, n_resamples=n_resamples)


# ------------------------------------------------------------- cross-validation (op 70e)

def cross_validate(key: str, df: DataFrame, features: Sequence[str], label: str, task: str, k: int = 5,
                   row_key: Sequence[str] | None = None, seed: int = 42, stratify: bool = False,
                   **params) -> DataFrame:
    """k-fold CV with preprocessing-free fits per fold; scores per fold plus
    mean and population sd.  Folds come from a keyed hash (stratified:
    exact class-balanced folds from the rank primitive)."""
    from cohortspark.operators.split import kfold, stratified_kfold
    d = (stratified_kfold(df, label, k, row_key, seed, "__fold") if stratify
         else kfold(df, k, row_key, seed, "__fold"))
    rows = []
    metric = "rmse" if task == "regression" else "accuracy"
    for f in range(k):
        tr, te = d.where(F.col("__fold") != f), d.where(F.col("__fold") == f)
        m = fit_model(key, tr, features, label, task, **params)
        rows.append((f, float(score_model(m, te, label, task)[metric])))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, f"fold long, {metric} double")
    return out.select("fold", metric, F.avg(metric).over(_all()).alias("mean"),
                      F.stddev_pop(metric).over(_all()).alias("sd"))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()  # over the k fold rows only


# ------------------------------------------------- kernel SVM approximation (op 136)

def _fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return float(np.sqrt(2.0 / len(b))) * np.cos(x @ w.T + b)


@dataclass
class RandomFourier(FittedModel):
    """RBF kernel machine approximated by random Fourier features
    z(x) = sqrt(2/D) cos(Wx + b) with W ~ N(0, 2·gamma) and a linear model on z."""
    name: str
    features: list[str]
    w: np.ndarray
    b: np.ndarray
    inner: FittedModel
    task: str = "regression"

    def _z(self, df):
        cols = []
        scale = float(np.sqrt(2.0 / len(self.b)))
        for j in range(len(self.b)):
            e = F.lit(float(self.b[j]))
            for i, f in enumerate(self.features):
                e = e + q(f).cast("double") * F.lit(float(self.w[j, i]))
            cols.append((F.lit(scale) * F.cos(e)).alias(f"__rff{j}"))
        return df.select("*", *cols)

    def transform(self, df):
        if isinstance(self.inner, LinearExpr):  # all terms of a batch in numpy, no column each
            w, b, coef, a = self.w, self.b, np.array(self.inner.coef), self.inner.intercept

            @F.pandas_udf("double")
            def score(*x: pd.Series) -> pd.Series:
                return pd.Series(a + _fourier(np.column_stack([v.to_numpy(dtype="float64") for v in x]), w, b) @ coef)

            return df.withColumn("prediction", score(*[q(f).cast("double") for f in self.features]))
        return self.inner.transform(self._z(df)).drop(*[f"__rff{j}" for j in range(len(self.b))])


def fit_rbf_svm(df, features, label, task="regression", C: float = 1.0, n_components: int = 100,
                seed: int = 42, name: str | None = None, max_iter: int = 100) -> RandomFourier:
    """SVR / SVC with RBF kernel, gamma='scale' (1 / (p · var(X))), as a
    declared approximation: random Fourier features + ridge (regression) or
    linear SVC (classification)."""
    feats = list(features)
    var = df.agg(*[F.var_pop(q(f).cast("double")).alias(f) for f in feats], F.avg(q(label).cast("double")).alias("__y")).first()
    gamma = 1.0 / (len(feats) * float(np.mean([var[f] or 1.0 for f in feats])))
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (n_components, len(feats)))
    b = rng.uniform(0, 2 * np.pi, n_components)
    proto = RandomFourier(name or ("svr" if task == "regression" else "svc_rbf"), feats, w, b, None, task)
    zc = [f"__rff{j}" for j in range(n_components)]
    if task == "regression":  # the features are made in the task that adds up their Gram
        g = total(gram(df, feats + [label], center=np.array([0.0] * n_components + [var["__y"] or 0.0]),
                       expand=lambda x: np.column_stack([_fourier(x[:, :-1], w, b), x[:, -1]]), names=zc + [label]))
        inner = _least_squares(g, zc, 1.0 / C, "ols")
    else:
        inner = fit_linear_svc(proto._z(df), zc, label, C, max_iter=max_iter)
    proto.inner = inner
    return proto
