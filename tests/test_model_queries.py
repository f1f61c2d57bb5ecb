"""Model and PCA queries on the real feature table of the smallest folder, against numpy closed forms."""

import numpy as np
import pytest

from harvestry.functions import domains as D
from harvestry.plans.catalog import Catalog
from harvestry.plans.registry import load_all
from harvestry.plans.suite_models import training
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def c(spark):
    return Catalog(spark, SF_SMALL)


@pytest.fixture(scope="module")
def run(c):
    reg = load_all()
    return lambda name: reg[name].build(c).toPandas()


def matrix(df):
    rows = df.select("k", "features", "label").collect()
    return [r.k for r in rows], np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])


@pytest.fixture(scope="module")
def table(c):
    return matrix(training(c).table)


@pytest.fixture(scope="module")
def ridge(c):
    """(k, X, y) of the test part, the closed-form coefficients on standardised features, and predictions."""
    _, X, y = matrix(training(c).parts[0])
    k, Xt, yt = matrix(training(c).parts[1])
    mean, std = X.mean(0), X.std(0)
    std[std == 0] = 1.0
    Z = (X - mean) / std
    w = np.linalg.solve(Z.T @ Z + 10.0 * np.eye(Z.shape[1]), Z.T @ (y - y.mean()))
    return k, yt, w, (Xt - mean) / std @ w + y.mean(), len(y)


def test_split_sizes(c, table, ridge):
    n = len(table[0])
    assert len(ridge[0]) == -(-n // 5) and ridge[4] == n - len(ridge[0])


def test_predictions_and_metrics(run, ridge):
    k, y, _, p, _ = ridge
    got = run("predictions").sort_values(["k", "actual", "predicted"])  # a few rows share a key
    want = sorted(zip(k, y, p))
    assert list(got.k) == [w[0] for w in want]
    assert np.abs(got.predicted.to_numpy() - np.array([w[2] for w in want])).max() < 1e-5 * np.abs(y).max()
    assert np.allclose(got.residual, got.actual - got.predicted)
    m = run("train_ridge").iloc[0]
    assert np.isclose(m.rmse, np.sqrt(np.mean((y - p) ** 2)), rtol=1e-6) and m.n_test == len(y)
    assert np.isclose(m.r2, 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), atol=1e-6)
    both = run("train_model").iloc[0]
    assert both.rmse == m.rmse and both.n_folds == 5 and both.cv_rmse_mean > 0


def test_coef_importance(run, ridge):
    w = dict(zip(D.FEATURES, ridge[2]))
    got = run("coef_importance")
    want = sorted(w, key=lambda f: -abs(w[f]))[:20]
    assert len(got) == 20 and np.allclose(sorted(np.abs(got.std_coef)), sorted(abs(w[f]) for f in want), rtol=1e-4, atol=1e-3)


def test_model_roundtrip(run):
    got = run("model_roundtrip")
    assert len(got) and got.drop_duplicates("k", keep=False)["equal"].all()


def test_pca(run, table):
    k, X, _ = table
    std = X.std(0)
    Z = (X - X.mean(0)) / np.where(std == 0, 1.0, std)
    values, vectors = np.linalg.eigh(np.cov(Z.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    share = values / values.sum()
    var = run("pca_variance").sort_values("component")
    assert np.allclose(var.explained_variance_ratio, share, atol=1e-9) and np.allclose(var.cumulative, np.cumsum(share), atol=1e-9)
    t = run("pca_table").sort_values("component")
    n = len(X)  # of data scaled by the population std, with the divisor n - 1
    assert np.allclose(t.eigenvalue, values * n / (n - 1), atol=1e-6)
    rank = run("effective_rank").iloc[0]
    assert rank.effective_rank == int((share > 1e-9).sum()) and rank.k_95 == int(np.argmax(np.cumsum(share) >= 0.95 - 1e-12)) + 1
    load = run("pca_loadings").pivot(index="feature", columns="component", values="loading").loc[D.FEATURES].to_numpy()
    apart = [j for j in range(5) if share[j] - share[j + 1] > 1e-3 and (j == 0 or share[j - 1] - share[j] > 1e-3)]
    assert apart and all(abs(abs(load[:, j] @ vectors[:, j]) - 1) < 1e-4 for j in apart)
    scores = run("pca_scores")
    for j in apart:
        want = sorted(zip(k, np.abs(Z @ vectors[:, j]).round(5)))
        have = sorted(zip(scores.k, scores[f"pc{j + 1}"].abs().round(5)))
        assert [w[0] for w in want] == [h[0] for h in have] and np.allclose([w[1] for w in want], [h[1] for h in have], atol=2e-5)
    assert len(run("pca_outputs")) == len(D.FEATURES) ** 2


def test_a_booster_asked_for_alone_is_fitted_alone(c, monkeypatch):
    """Without errors by fold no other booster and no fold is fitted; the trees are those of the joint fit."""
    from harvestry.operators import models as M
    from harvestry.plans.suite_models import Training

    few = {n: M.ModelSpec(n, "gbt", M.SPECS[n].params | {"n_estimators": 2}) for n in M.BOOSTERS}
    for n, spec in few.items():
        monkeypatch.setitem(M.SPECS, n, spec)
    t, joint = Training(c), M.fit_boosters
    t.__dict__ |= {k: getattr(training(c), k) for k in ("table", "parts", "fold", "binned")}
    monkeypatch.setattr(M, "fit_boosters", lambda *_: pytest.fail("the joint fit"))
    alone = t.fit("xgboost")[0]
    monkeypatch.setattr(M, "fit_boosters", joint)
    both = Training(c)
    both.__dict__ |= {k: getattr(t, k) for k in ("table", "parts", "fold", "binned")}
    assert both.cv("xgboost").first().n_folds == 5
    for a, b in zip(alone.trees, both.fit("xgboost")[0].trees):
        assert np.array_equal(a[0], b[0]) and np.allclose(a[3], b[3])
