"""Preprocessing plan (op 118c): the ordered composition of fitted steps.

Order: units -> plausibility gate -> numeric impute (+ indicators) -> power
transform -> outlier capping -> scaling, in parallel with categorical impute ->
encode; then optional k-means features (replacing the inputs) and PCA.
``fit`` sees training rows only; the fitted plan applies to any DataFrame,
batch or streaming, as Column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from cohortspark.functions.columns import q
from cohortspark.operators import preprocess as pp
from cohortspark.operators.plausibility import harmonize_units, plausibility_gate


@dataclass
class PreprocessConfig:
    numeric_features: Sequence[str]
    categorical_features: Sequence[str] = ()
    numeric_imputation: str = "median"          # mean | median | constant | iterative | none
    numeric_scaling: str = "standard"           # standard | robust | minmax | none
    numeric_log_transform: bool = False
    numeric_power_transform: str = "none"       # none | yeo-johnson | log1p
    numeric_missing_indicators: bool = False
    numeric_outlier_treatment: str = "none"     # none | percentile | mad
    numeric_outlier_params: Mapping | None = None
    unit_factors: Mapping[str, float] | None = None
    plausibility_bounds: Mapping[str, tuple[float, float]] | None = None
    categorical_imputation: str = "most_frequent"
    categorical_encoding: str = "onehot"        # onehot | ordinal | target
    use_kmeans_features: bool = False
    kmeans_n_clusters: int = 5
    kmeans_add_distances: bool = True
    kmeans_add_onehot: bool = False
    use_pca: bool = False
    pca_n_components: float | int | None = None
    pca_whiten: bool = False
    random_state: int = 42


@dataclass
class FittedPipeline:
    steps: list = field(default_factory=list)
    feature_names: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    #: the training rows as later steps and models should see them: with target
    #: encoding a row's own fold has no part in its value (rows without target are left out)
    train: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def features(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Transform and assemble the model matrix as one vector column."""
        return self._assembled(self.transform(df), output)

    def train_features(self, output: str = "features") -> DataFrame:
        """The model matrix of the training rows, free of target leakage."""
        return self._assembled(self.train, output)

    def _assembled(self, t: DataFrame, output: str) -> DataFrame:
        va = VectorAssembler(inputCols=self.feature_names, outputCol=output, handleInvalid="keep")
        return va.transform(t).select(*[q(c) for c in self.keep], output)


@dataclass
class UnitFactors(pp.Fitted):
    factors: dict[str, float]

    def transform(self, df):
        return harmonize_units(df, self.factors)


@dataclass
class PlausibleRange(pp.Fitted):
    bounds: dict[str, tuple[float, float]]

    def transform(self, df):
        return plausibility_gate(df, self.bounds)


def fit_pipeline(train: DataFrame, cfg: PreprocessConfig, target: str | None = None,
                 keep: Sequence[str] = ()) -> FittedPipeline:
    num, cat = list(cfg.numeric_features), list(cfg.categorical_features)
    fp = FittedPipeline(keep=list(keep) + ([target] if target and target not in keep else []))
    cur = train.select(*[q(c) for c in dict.fromkeys(num + cat + fp.keep)])

    def add(step):
        nonlocal cur
        fp.steps.append(step)
        cur = step.transform(cur)

    if cfg.unit_factors:
        add(UnitFactors(dict(cfg.unit_factors)))
    if cfg.plausibility_bounds:
        add(PlausibleRange(dict(cfg.plausibility_bounds)))
    names = list(num)
    if num:
        if cfg.numeric_imputation == "iterative":
            add(pp.fit_iterative_imputer(cur, num))
        elif cfg.numeric_imputation != "none":
            imp = pp.fit_numeric_imputer(cur, num, cfg.numeric_imputation, cfg.numeric_missing_indicators)
            add(imp)
            names += [f"missingindicator_{c}" for c in imp.indicators]
        if cfg.numeric_power_transform == "yeo-johnson":
            add(pp.fit_yeo_johnson(cur, num))
        elif cfg.numeric_log_transform or cfg.numeric_power_transform == "log1p":
            add(pp.Log1p(num))
        if cfg.numeric_outlier_treatment not in (None, "none"):
            add(pp.fit_outlier_capping(cur, num, cfg.numeric_outlier_treatment, cfg.numeric_outlier_params))
        if cfg.numeric_scaling != "none":
            add(pp.fit_scaler(cur, num, cfg.numeric_scaling))
    if cat:
        if cfg.categorical_imputation in ("most_frequent", "constant"):
            add(pp.fit_categorical_imputer(cur, cat, cfg.categorical_imputation))
        if cfg.categorical_encoding == "ordinal":
            add(pp.fit_ordinal(cur, cat))
            names += cat
        elif cfg.categorical_encoding == "target" and target:
            enc, cur = pp.fit_target_encoder(cur, cat, target, seed=cfg.random_state)  # train rows: out of fold
            fp.steps.append(enc)
            names += cat
        else:
            oh = pp.fit_one_hot(cur, cat)
            add(oh)
            names += oh.output_names()
    if cfg.use_kmeans_features:
        km = pp.fit_kmeans_features(cur, names, cfg.kmeans_n_clusters, cfg.random_state,
                                    cfg.kmeans_add_distances, cfg.kmeans_add_onehot)
        add(km)
        names = ([f"kmeans_dist_{j}" for j in range(len(km.centers))] if km.add_distances else []) + \
                ([f"kmeans_label_{j}" for j in range(len(km.centers))] if km.add_onehot else [])
    if cfg.use_pca:
        pca = pp.fit_pca(cur, names, cfg.pca_n_components, cfg.pca_whiten)
        add(pca)
        names = [f"pca{j}" for j in range(pca.components.shape[0])]
    fp.feature_names = names
    fp.train = cur
    return fp


# Models that need scaled inputs, and high-interpretability models.
SCALE_SENSITIVE = ("ridge", "lasso", "elasticnet", "logreg", "knn", "svr", "svc", "nn", "glm", "huber", "lda")
INTERPRETABLE = ("ridge", "lasso", "elasticnet", "logreg", "glm", "huber")


def default_config(model: str, numeric: Sequence[str], categorical: Sequence[str],
                   high_interpretability: bool = False, **overrides) -> PreprocessConfig:
    """Per-model defaults: scaling for scale-sensitive models; interpretability
    disables log / PCA / k-means."""
    cfg = dict(numeric_features=list(numeric), categorical_features=list(categorical),
               numeric_scaling="standard" if model in SCALE_SENSITIVE else "none")
    cfg.update(overrides)
    if high_interpretability and model in INTERPRETABLE:
        cfg.update(numeric_log_transform=False, use_pca=False, use_kmeans_features=False,
                   numeric_power_transform="none")
    return PreprocessConfig(**cfg)


def legacy_prepare(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str] | None = None,
                   val_size: float = 0.15, test_size: float = 0.15, seed: int = 42) -> DataFrame:
    """The original one-shot preparation (op 26): numeric coercion with
    ``try_cast``; a categorical target drops rows where it is missing, a
    numeric one is median-filled; features median-filled; 70/15/15 hash split;
    standardisation fitted on the training part only.  Returns the prepared
    rows with a ``split`` column."""
    from pyspark.sql import functions as F

    from cohortspark.functions.columns import is_numeric_type
    from cohortspark.operators.split import random_split
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = list(features)
    t = df.select(*[q(k) for k in (key or [])],
                  *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in feats], q(target))
    if is_numeric_type(types[target]):
        med = pp.fit_numeric_imputer(t, [target], "median")
        t = med.transform(t)
    else:
        t = t.where(q(target).isNotNull())
    t = pp.fit_numeric_imputer(t, feats, "median").transform(t)
    t = random_split(t, list(key) if key else None, 1 - val_size - test_size, val_size, seed)
    scaler = pp.fit_scaler(t.where(F.col("split") == "train"), feats, "standard")
    return scaler.transform(t)
