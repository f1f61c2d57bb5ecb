"""Model fitting, evaluation and PCA.

Training data is the feature table assembled into one vector column, split at an
exact cut of the hash order of the row key (no sort). Ridge and PCA are Spark ML
estimators; forests and boosters come from ``operators.trees``. Cross-validation
never refits from scratch: ridge folds are the total moments less a fold's, tree
learners of all folds advance in the same passes. Only model parameters reach the
driver (36 coefficients, 36x36 loadings, trees, per-model metrics).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round
from harvestry.operators import trees as T
from harvestry.operators.profiling import regression_metrics
from harvestry.operators.ranking import exact_folds, exact_split


@dataclass
class ModelSpec:
    """M6 registry entry: name, family, published parameters."""
    name: str
    family: str
    params: dict

    def estimator(self, n_rows: int | None = None, std_y: float | None = None):
        """Ridge: alpha on standardised features == Spark's normal-equation solver with regParam = alpha * std_pop(y) / n."""
        reg = self.params["alpha"] * (std_y or 1.0) / max(n_rows or 1, 1)
        return LinearRegression(featuresCol="features", labelCol="label", solver="normal",
                                elasticNetParam=0.0, standardization=True, regParam=reg)

    def growth(self) -> T.Growth:
        p = self.params
        return T.Growth(trees=p["n_estimators"], depth=p["max_depth"], rate=p.get("learning_rate"), leaves=p.get("max_leaves"),
                        min_rows=p.get("min_samples_leaf", 1), min_weight=p.get("min_child_weight", 0.0), l2=p.get("l2", 0.0),
                        rows=p.get("subsample", 1.0), features=p.get("colsample", 1.0))


# --- fixed values: published hyper-parameters of the five models, with the
# defaults of the published libraries where those decide how trees grow --------
REGISTRY = [
    ModelSpec("ridge", "ridge", {"alpha": 10.0}),
    ModelSpec("random_forest", "random_forest", {"n_estimators": 100, "max_depth": 20, "min_samples_leaf": 5}),
    # best first, 31 leaves; first-order gains
    ModelSpec("hist_gradient_boosting", "gbt",
              {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 8, "min_samples_leaf": 20, "max_leaves": 31}),
    # by level; L2 of 1 in gains and leaves, a hessian of 1 per child; rows and features sampled per tree
    ModelSpec("xgboost", "gbt",
              {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 6, "l2": 1.0, "min_child_weight": 1.0, "subsample": 0.8, "colsample": 0.8}),
    # best first, 63 leaves; its row share has no effect without a sampling frequency, which is not set
    ModelSpec("lightgbm", "gbt",
              {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 8, "max_leaves": 63, "min_samples_leaf": 20, "colsample": 0.8}),
]
SPECS = {s.name: s for s in REGISTRY}
BOOSTERS = [s.name for s in REGISTRY if s.family == "gbt"]


def params_text(spec: ModelSpec) -> str:
    return ", ".join(f"{k}={v}" for k, v in spec.params.items())


def registry_frame(spark: SparkSession) -> DataFrame:
    """M6 as a table: model, family, scale flag, parameters."""
    rows = [(s.name, s.family, s.family == "ridge", params_text(s)) for s in REGISTRY]
    return spark.createDataFrame(rows, "model string, family string, scale boolean, params string")


def assemble(features: DataFrame, key: str | None = None, feature_cols=None) -> DataFrame:
    """Vector column ``features`` + ``label`` (+ the key). A null feature is an error: no row is dropped silently."""
    cols = feature_cols or D.FEATURES
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    keep = [key] if key else []
    return va.transform(features).select(*keep, "features", F.col(D.TARGET).cast("double").alias("label"))


def split(assembled: DataFrame, key: str, test_pct: int = 20) -> tuple[DataFrame, DataFrame]:
    """O7 applied: exactly ceil(n * test_pct / 100) test rows, the rest for training."""
    flag = exact_split(assembled, F.col(key), test_pct, 42)
    return assembled.where(~flag), assembled.where(flag)


def label_stats(df: DataFrame) -> tuple[int, float]:
    """Row count and population std of the label (one aggregate, two numbers)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    return int(r["n"]), float(r["s"] or 0.0)


@dataclass
class Binned:
    """A training table as blocks of binned features with folds, for the tree learners."""
    edges: list
    blocks: DataFrame
    totals: dict
    n_features: int

    @classmethod
    def of(cls, train: DataFrame, n_features: int, fold: Column | None = None) -> Binned:
        edges = T.bin_edges(train, n_features)
        blocks = T.write_blocks(train, edges, fold)
        return cls(edges, blocks, T.fold_totals(blocks), n_features)

    def model(self, growth: T.Growth, trees: list[T.Tree], base: float = 0.0) -> T.TreeModel:
        return T.TreeModel.of(trees, base, growth, self.edges)


def fit(spec: ModelSpec, train: DataFrame, binned: Binned | None = None):
    """(fitted model, seconds); tree models take ``binned`` where the table has been binned before."""
    if spec.family == "ridge":
        n, s = label_stats(train)
        t0 = time.time()
        model = Pipeline(stages=[spec.estimator(n, s)]).fit(train)
        return model, time.time() - t0
    b = binned or Binned.of(train, len(train.select(vector_to_array("features").alias("a")).first().a))
    t0, growth = time.time(), spec.growth()
    if growth.rate is None:
        (files,) = T.grow_forests(b.blocks, [T.Learner(growth)], b.n_features, b.totals)
        model = T.forest_model(files, growth, b.edges)
    else:
        ((base, trees),), _ = T.fit_boosters(b.blocks, [T.Learner(growth)], b.n_features, b.totals)
        model = b.model(growth, trees, base)
    return model, time.time() - t0


def fit_boosters(specs: Sequence[ModelSpec], b: Binned, folds: int = 5) -> dict[str, tuple[T.TreeModel, list[float]]]:
    """Each booster with its RMSE per fold: the boosters and all their folds advance tree by tree in the same passes."""
    learners = [T.Learner(s.growth(), k) for s in specs for k in (None, *range(folds))]
    fits, scored = T.fit_boosters(b.blocks, learners, b.n_features, b.totals)
    errors = T.held_out_errors(scored, learners, b.n_features)
    out = {}
    for i, s in enumerate(specs):
        at = i * (folds + 1)
        base, trees = fits[at]
        out[s.name] = (b.model(s.growth(), trees, base), [errors[at + 1 + k] for k in range(folds) if at + 1 + k in errors])
    return out


def used_params(model) -> dict[str, str]:
    """The settings that the fitted model itself holds, as text, with the trees it has."""
    if isinstance(model, (T.TreeModel, T.StoredForest)):
        return {k: str(v) for k, v in model.settings.items() if v is not None}
    stage = model.stages[-1]
    return {p.name: str(v) for p, v in stage.extractParamMap().items() if not p.name.endswith("Col")}


def predictions(model, df: DataFrame, keep=()) -> DataFrame:
    """Actual, predicted, residual."""
    return model.transform(df).select(*keep, F.col("label").alias("actual"), F.col("prediction").alias("predicted"),
                                      (F.col("label") - F.col("prediction")).alias("residual"))


def score_model(name: str, model, secs: float, test: DataFrame) -> DataFrame:
    """M7's metrics row of a fitted model."""
    m = regression_metrics(predictions(model, test), "actual", "predicted")
    return m.select(F.lit(name).alias("model"), "rmse", "mae", "r2", "mape",
                    F.col("n").alias("n_test"), F.lit(round(secs, 3)).alias("fit_seconds"))


# ---------------------------------------------------------------------------
# Cross-validation (M9)
# ---------------------------------------------------------------------------

def fold_moments(data: DataFrame, fold: Column, n_features: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per fold: rows, sums and products of (features, label), about the overall means so that nothing cancels. One pass."""
    a = vector_to_array(F.col("features"))
    means = data.agg(*[F.avg(a[i]) for i in range(n_features)], F.avg("label")).first()
    centre = np.array([m or 0.0 for m in means])
    slim = data.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), fold.cast("int").alias("fold"))
    schema = "fold int, n long, s binary, g binary"

    def packed(held):
        for k, (n, s, g) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([s.tobytes()]), pa.array([g.tobytes()])],
                                             names=["fold", "n", "s", "g"])

    def add(held, k, n, s, g):
        m, t, h = held.get(k, (0, 0.0, 0.0))
        held[k] = (m + n, t + s, h + g)

    def count(batches):
        held = {}
        for b in batches:
            z = np.column_stack([b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("y").to_numpy()]) - centre
            of = b.column("fold").to_numpy()
            for k in np.unique(of):
                part = z[of == k]
                add(held, int(k), len(part), part.sum(0), part.T @ part)
        yield from packed(held)

    def merge(batches):
        held = {}
        for b in batches:
            for k, n, s, g in zip(*(b.column(c).to_pylist() for c in ("fold", "n", "s", "g"))):
                add(held, k, n, np.frombuffer(s), np.frombuffer(g).reshape(len(centre), -1))
        yield from packed(held)

    rows = slim.mapInArrow(count, schema).repartition("fold").mapInArrow(merge, schema).collect()  # a row per fold
    return {r.fold: (r.n, np.frombuffer(r.s), np.frombuffer(r.g).reshape(len(centre), -1)) for r in rows}


def ridge_fold_errors(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], alpha: float) -> list[float]:
    """RMSE of ridge on each fold, fitted on the total less that fold; closed forms of the moments."""
    total = [sum(m[i] for m in moments.values()) for i in range(3)]
    out = []
    for k in sorted(moments):
        held_out = moments[k]
        n, s, g = (t - h for t, h in zip(total, held_out))
        if not n or not held_out[0]:
            continue
        mean = s / n
        cov = g / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
        std[std < 1e-12] = 1.0
        corr, to_y = cov[:-1, :-1] / np.outer(std, std), cov[:-1, -1] / std
        w = np.linalg.solve(n * corr + alpha * np.eye(len(std)), n * to_y) / std
        u = np.append(-w, 1.0)  # residual = u . (features, label) - u . mean
        m, t, h = held_out
        c = u @ mean
        out.append(float(np.sqrt(max(u @ h @ u - 2 * c * (u @ t) + m * c * c, 0.0) / m)))
    return out


def fold_errors(spec: ModelSpec, data: DataFrame, key: str, folds: int = 5) -> list[float]:
    """M9: RMSE of each fold (consecutive stretches of the hash order of ``key``, sizes within one row)."""
    fold = exact_folds(data, F.col(key), folds, 42)
    n_features = len(data.select(vector_to_array("features").alias("a")).first().a)
    if spec.family == "ridge":
        return ridge_fold_errors(fold_moments(data, fold, n_features), spec.params["alpha"])
    b = Binned.of(data, n_features, fold)
    return forest_fold_errors(spec, b, folds) if spec.growth().rate is None else fit_boosters([spec], b, folds)[spec.name][1]


def forest_fold_errors(spec: ModelSpec, b: Binned, folds: int = 5) -> list[float]:
    """RMSE of one forest per fold."""
    errors = T.forest_errors(b.blocks, [T.Learner(spec.growth(), k) for k in range(folds)], b.n_features, b.totals)
    return [errors[k] for k in sorted(errors)]


def cv_row(spark: SparkSession, name: str, errors: list[float]) -> DataFrame:
    """Mean and population std of the folds' RMSE."""
    per = spark.createDataFrame([(e,) for e in errors], "rmse double")
    return per.agg(F.lit(name).alias("model"), np_round(F.avg("rmse"), 6).alias("cv_rmse_mean"),
                   np_round(F.stddev_pop("rmse"), 6).alias("cv_rmse_std"), F.count(F.lit(1)).alias("n_folds"))


def cv_rmse(spec: ModelSpec, data: DataFrame, key: str, folds: int = 5) -> DataFrame:
    return cv_row(data.sparkSession, spec.name, fold_errors(spec, data, key, folds))


def coef_importance(model: PipelineModel, train: DataFrame, top: int = 20) -> DataFrame:
    """Standardised coefficients (coef x population std of the feature),
    sign kept, top by magnitude."""
    lr = model.stages[-1]
    coefs = [float(x) for x in lr.coefficients]
    spark = train.sparkSession
    stds = train.select(vector_to_array("features").alias("a")).select(
        *[F.stddev_pop(F.col("a")[i]).alias(f"s{i}") for i in range(len(coefs))]).first()
    rows = [(f, c, c * float(stds[f"s{i}"] or 0.0)) for i, (f, c) in enumerate(zip(D.FEATURES, coefs))]
    df = spark.createDataFrame(rows, "feature string, coef double, std_coef double")
    return df.orderBy(F.desc(F.abs("std_coef")), "feature").limit(top)


def tree_importance(model: T.TreeModel, top: int = 20) -> DataFrame:
    """Importances, top-k, banded at their own 50 / 75 % quantiles."""
    imp = [float(x) for x in model.importances]
    from pyspark.sql import SparkSession as _S
    spark = _S.getActiveSession()
    df = spark.createDataFrame(list(zip(D.FEATURES, imp)), "feature string, importance double")
    top_df = df.orderBy(F.desc("importance"), "feature").limit(top)
    q50 = top_df.agg(F.percentile("importance", 0.5)).scalar()
    q75 = top_df.agg(F.percentile("importance", 0.75)).scalar()
    return top_df.withColumn("band", F.when(F.col("importance") >= q75, "high")
                             .when(F.col("importance") >= q50, "medium").otherwise("low"))


# ---------------------------------------------------------------------------
# PCA (X10–X14)
# ---------------------------------------------------------------------------

def fit_pca(assembled: DataFrame, k: int | None = None):
    """Standardise (mean 0, unit sample std) then PCA with all components. The
    36 x 36 covariance is a distributed tree-aggregate; only it reaches the
    driver. Components and shares do not depend on the std's divisor; scores and
    eigenvalues are scaled to the population std where they are returned."""
    k = k or len(D.FEATURES)
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True),
                            PCA(k=k, inputCol="z", outputCol="pcs")])
    return pipe.fit(assembled)


def scaled_variance(model: PipelineModel) -> float:
    """The total sample variance of the scaled data: 1 for each feature that varies, 0 for a constant one, which the scaler maps to 0."""
    return float(sum(s > 0 for s in model.stages[0].std))


def pca_variance(model: PipelineModel) -> DataFrame:
    """X10 + W3: explained-variance ratio and cumulative share per component."""
    evr = [float(x) for x in model.stages[-1].explainedVariance.toArray()]
    spark = SparkSession.getActiveSession()
    rows, cum = [], 0.0
    for i, r in enumerate(evr, 1):
        cum += r
        rows.append((i, r, cum))
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative double")


def pca_loadings(model: PipelineModel, digits: int = 6) -> DataFrame:
    """X11: long (feature, component, loading); each component's sign is fixed
    so that its largest-magnitude loading is positive."""
    pc = model.stages[-1].pc.toArray()
    rows = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        sign = 1.0 if col[abs(col).argmax()] >= 0 else -1.0
        rows += [(D.FEATURES[i], j + 1, float(sign * col[i])) for i in range(pc.shape[0])]
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "feature string, component int, loading double")
    return df.withColumn("loading", np_round("loading", digits))


def pca_table(model: PipelineModel, total_variance: float) -> DataFrame:
    """Eigenvalue, %, cumulative %, top feature of each component."""
    var = pca_variance(model)
    load = pca_loadings(model)
    top = load.groupBy("component").agg(
        F.min(F.struct((-F.abs("loading")).alias("a"), F.col("feature").alias("f"))).alias("_t"))
    return (var.join(top, "component")
            .select("component", (F.col("explained_variance_ratio") * F.lit(total_variance)).alias("eigenvalue"),
                    (F.col("explained_variance_ratio") * 100).alias("pct"), (F.col("cumulative") * 100).alias("cum_pct"),
                    F.col("_t.f").alias("top_feature")))


def effective_rank(model: PipelineModel, tol: float = 1e-9) -> DataFrame:
    """X14 + W4: components with non-zero variance; k for 90/95/99 %."""
    var = pca_variance(model)
    return var.agg(F.count(F.when(F.col("explained_variance_ratio") > tol, 1)).alias("effective_rank"),
                   *[F.min(F.when(F.col("cumulative") >= t - 1e-12, F.col("component"))).alias(f"k_{int(t * 100)}")
                     for t in (0.90, 0.95, 0.99)])
