"""Ridge equals the closed-form solution; PCA reproduces the published structure."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from harvestry.operators import models as M


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(500, 4)) * np.array([1.0, 5.0, 0.5, 2.0]) + 3.0
    y = X @ np.array([2.0, -1.0, 4.0, 0.5]) + rng.normal(size=500) + 10.0
    alpha = 10.0
    # sklearn Ridge on standardised X (population std), intercept unpenalised
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    yc = y - y.mean()
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(4), Z.T @ yc)
    pred_ref = Z @ w + y.mean()
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(X, y)], schema)
    model, _ = M.fit(M.SPECS["ridge"], df)
    pred = np.array([r.prediction for r in model.transform(df).select("prediction").collect()])
    assert np.max(np.abs(pred - pred_ref)) < 1e-6


def test_registry_has_five_models(spark):
    assert [r.model for r in M.registry_frame(spark).collect()] == [
        "ridge", "random_forest", "hist_gradient_boosting", "xgboost", "lightgbm"]


def _frame(spark, n=300):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    rng = np.random.default_rng(7)
    X = rng.normal(size=(n, 36)) @ np.diag(np.linspace(0.5, 3, 36))
    y = X[:, 0] * 3 + X[:, 5] ** 2 + rng.normal(size=n)
    schema = StructType([StructField("k", StringType()), StructField("features", VectorUDT()), StructField("label", DoubleType())])
    return X, y, spark.createDataFrame([(str(i), Vectors.dense(x.tolist()), float(t)) for i, (x, t) in enumerate(zip(X, y))], schema)


def test_learners_have_the_published_settings():
    """Every setting of the registry reaches the learner; the four differ."""
    got = {s.name: s.growth() for s in M.REGISTRY if s.family != "ridge"}
    forest = got["random_forest"]
    assert (forest.trees, forest.depth, forest.min_rows, forest.rate) == (100, 20, 5, None)
    boosters = {n: (g.trees, g.rate, g.depth, g.leaves, g.min_rows, g.l2, g.rows, g.features) for n, g in got.items() if n != "random_forest"}
    assert boosters == {"hist_gradient_boosting": (200, 0.05, 8, 31, 20, 0.0, 1.0, 1.0), "xgboost": (200, 0.05, 6, None, 1, 1.0, 0.8, 0.8),
                        "lightgbm": (200, 0.05, 8, 63, 20, 0.0, 1.0, 0.8)}


def test_run_log_reads_the_fitted_model(spark):
    _, _, df = _frame(spark)
    spec = M.ModelSpec("small", "random_forest", {"n_estimators": 7, "max_depth": 3, "min_samples_leaf": 5})
    model, _ = M.fit(spec, df)
    used = M.used_params(model)
    assert (used["trees"], used["depth"], used["min_rows"], used["fitted_trees"]) == ("7", "3", "5", "7") and int(used["fitted_leaves"]) <= 8
    imp = M.tree_importance(model, 36).collect()
    assert len(imp) == 36 and abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_ridge_folds_by_subtraction_equal_separate_fits(spark):
    from harvestry.operators.ranking import exact_folds
    _, _, df = _frame(spark, 400)
    fold = exact_folds(df, F.col("k"), 5, 42)
    got = M.ridge_fold_errors(M.fold_moments(df, fold, 36), 10.0)
    for k in range(5):
        model, _ = M.fit(M.SPECS["ridge"], df.where(fold != k))
        e = F.col("label") - F.col("prediction")
        alone = model.transform(df.where(fold == k)).agg(F.sqrt(F.avg(e * e))).first()[0]
        assert abs(got[k] - alone) < 1e-9 * alone


def test_every_family_is_cross_validated(spark):
    X, y, df = _frame(spark)
    for spec in (M.ModelSpec("f", "random_forest", {"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 5}),
                 M.ModelSpec("b", "gbt", {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3})):
        r = M.cv_rmse(spec, df, "k", 5).first()
        assert r.n_folds == 5 and 0 < r.cv_rmse_mean < y.std() * 1.2


def test_null_feature_is_an_error(spark):
    import pytest
    from harvestry.functions import domains as D
    row = spark.range(1).selectExpr(*[f"cast(null as double) as {f}" for f in D.FEATURES], f"1.0 as {D.TARGET}")
    with pytest.raises(Exception):
        M.assemble(row).collect()


def test_pca_rebuilds_the_correlation_matrix(spark):
    X, _, df = _frame(spark)
    model = M.fit_pca(df)
    load = M.pca_loadings(model, 12).toPandas().pivot(index="feature", columns="component", values="loading")
    from harvestry.functions import domains as D
    V = load.loc[D.FEATURES].to_numpy()
    share = [r.explained_variance_ratio for r in M.pca_variance(model).collect()]
    n = len(X)
    table = M.pca_table(model, 36.0 * n / (n - 1)).orderBy("component").collect()
    rebuilt = V @ np.diag(np.array(share) * 36) @ V.T
    assert np.abs(rebuilt - np.corrcoef(X.T)).max() < 1e-6
    assert abs(table[0].eigenvalue - share[0] * 36 * n / (n - 1)) < 1e-9


def test_cross_validation_and_round_trip(spark):
    from pyspark.ml import PipelineModel
    from harvestry.session import shared_path
    _, _, df = _frame(spark)
    cv = M.cv_rmse(M.SPECS["ridge"], df, "k", 5).first()
    assert cv.n_folds == 5 and cv.cv_rmse_mean > 0 and cv.cv_rmse_std >= 0
    model, _ = M.fit(M.SPECS["ridge"], df)
    path = shared_path(spark, "model")
    model.write().save(path)
    a, b = (M.predictions(m, df, ["k"]).orderBy("k").collect() for m in (model, PipelineModel.load(path)))
    assert a == b


def test_every_registry_model_is_cross_validated(spark, monkeypatch):
    from harvestry.plans import suite_models as S

    class Stub:
        def scores(self, name):
            return spark.createDataFrame([(name, 0.5)], "model string, r2 double")

        def cv(self, name):
            return spark.createDataFrame([(name, 1.0, 0.1)], "model string, cv_rmse_mean double, cv_rmse_std double")

    monkeypatch.setattr(S, "training", lambda c: Stub())
    rows = S.train_all(None).collect()
    assert {r.model for r in rows if r.cv_rmse_mean is not None and r.cv_rmse_std is not None} == set(M.SPECS)
