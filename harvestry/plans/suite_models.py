"""Queries: models, evaluation and PCA (M1–M15, W5, X10–X15, S13, S14, S16,
S17). All fits use the published settings. The training table is written once
per session and folder, and each model is fitted once; the queries that show
the same fits share them through ``Training``."""

from __future__ import annotations

import hashlib
import time
from functools import cache, cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.features import build_features
from harvestry.functions.numeric import np_round
from harvestry.operators import fitted as X
from harvestry.operators import models as M
from harvestry.operators import scoring as R
from harvestry.operators.ranking import exact_folds, mean_rank
from harvestry.plans.registry import query
from harvestry.session import shared_path, stable_path, write_parquet
from harvestry.sources import fixtures as FX
from harvestry.sources.runs import append_run, read_runs


FOLDS = 5


class Training:
    """The training table of one folder and the models fitted on it."""

    def __init__(self, c):
        self.c = c
        self.fit = cache(self._fit)
        self.scores = cache(self._scores)
        self.cv = cache(self._cv)
        self.scorer = cache(self._scorer)

    @cached_property
    def table(self):
        """Written once: every estimator makes several passes over it, and a
        lost executor's part is read again from the shared folder."""
        c = self.c
        key = F.concat_ws("-", *[F.col(k).cast("string") for k in FX.OBS_KEY]).alias("k")
        feats = build_features(c.merged_keyed.select(key, *D.MERGED_COLUMNS), keep=["k"])
        path = shared_path(c.spark, "training")
        write_parquet(M.assemble(feats, key="k"), path, compression="zstd")
        return c.spark.read.parquet(path)

    @cached_property
    def parts(self):
        return M.split(self.table, "k")

    @cached_property
    def fold(self):
        return exact_folds(self.parts[0], F.col("k"), FOLDS, 42)

    @cached_property
    def binned(self):
        return M.Binned.of(self.parts[0], len(D.FEATURES), self.fold)

    @cached_property
    def boosters(self):
        """The three boosters and their folds, fitted together where errors by fold are asked for; their seconds are those of
        the whole. A booster whose fit alone is asked for is fitted alone (``fit``), to the same trees."""
        t0 = time.time()
        fits = M.fit_boosters([M.SPECS[n] for n in M.BOOSTERS], self.binned, FOLDS)
        return fits, time.time() - t0

    def _fit(self, name):
        if name in M.BOOSTERS and "boosters" in vars(self):  # fitted with their folds before
            fits, secs = self.boosters
            return fits[name][0], secs
        return M.fit(M.SPECS[name], self.parts[0], None if name == "ridge" else self.binned)

    def _scores(self, name):
        """One row of metrics, written, so that later queries read it."""
        model, secs = self.fit(name)
        return self._kept(M.score_model(name, model, secs, self.parts[1]), "score")

    def _cv(self, name):
        if name == "ridge":
            errors = M.ridge_fold_errors(M.fold_moments(self.parts[0], self.fold, len(D.FEATURES)), M.SPECS[name].params["alpha"])
        elif name in M.BOOSTERS:
            errors = self.boosters[0][name][1]
        else:
            errors = M.forest_fold_errors(M.SPECS[name], self.binned, FOLDS)
        return self._kept(M.cv_row(self.c.spark, name, errors), "cv")

    def _scorer(self, name):
        """The model as a user gets it: saved, loaded, ready for the what-if operators."""
        path = shared_path(self.c.spark, f"model-{name}")
        X.save_model(self.c.spark, self.fit(name)[0], path)
        return X.load_scorer(self.c.spark, path)

    def _kept(self, df, name):
        path = shared_path(self.c.spark, name)
        df.write.parquet(path)
        return self.c.spark.read.parquet(path)


_TRAININGS: dict[tuple[str, str], Training] = {}


def training(c) -> Training:
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    return _TRAININGS.setdefault(key, Training(c))


def assembled(c):
    return training(c).table


def train_test(c):
    return training(c).parts


@query("model_registry", f"""
select r.*, n.n - n.n_test as n_train, n.n_test from (values {", ".join(f"('{s.name}', '{s.family}', {str(s.family == 'ridge').lower()}, '{M.params_text(s)}')" for s in M.REGISTRY)})
  as r(model, family, scale, params),
  (select count(*) as n, (count(*) * 20 + 99) // 100 as n_test from merged) n""", ops="M6")
def q_model_registry(c):
    """The registry beside the rows that its models learn from and are tested on."""
    n = c.merged.agg(F.count(F.lit(1)).alias("n")).select("n", F.floor((F.col("n") * 20 + 99) / 100).cast("bigint").alias("n_test"))
    one = M.registry_frame(c.spark).withColumns({"_n": n.select("n").scalar(), "n_test": n.select("n_test").scalar()})
    return one.withColumn("n_train", F.col("_n") - F.col("n_test")).drop("_n")


def _train(name):
    def run(c):
        return training(c).scores(name)
    return run


for _key, _name, _ops in [("train_ridge", "ridge", "M1"), ("train_random_forest", "random_forest", "M2"),
                          ("train_hist_gbt", "hist_gradient_boosting", "M3"), ("train_gbt_sampled", "xgboost", "M4"),
                          ("train_gbt_leaves", "lightgbm", "M5")]:
    query(_key, None, ops=_ops)(_train(_name))


METRICS = ("rmse", "mae", "r2", "mape", "cv_rmse_mean", "cv_rmse_std", "fit_seconds")


def _run_row(c, name):
    t = training(c)
    cv = t.cv(name)  # before the fit, which it brings along for boosters
    params = M.used_params(t.fit(name)[0])
    pairs = lambda names, value: F.create_map(*[x for k in names for x in (F.lit(k), value(k))])
    return t.scores(name).join(cv, "model").select(
        "model", pairs(sorted(params), lambda k: F.lit(params[k])).alias("params"),
        pairs(METRICS, lambda k: F.col(k).cast("double")).alias("metrics"))


def _log(c, name):
    """Add the session's run of a model on this folder to the lasting log; a second call finds it there."""
    log = stable_path(c.spark, "model_runs")
    folder = hashlib.md5(c.sf_dir.encode()).hexdigest()[:8]
    append_run(_run_row(c, name), log, f"{c.spark.sparkContext.applicationId}-{folder}-{name}")
    return log


@query("train_model", None, ops="M7 M9")
def q_train_model(c):
    """One model end to end: CV RMSE on the training part, fit, test metrics, a row in the run log."""
    t = training(c)
    _log(c, "ridge")
    return t.scores("ridge").join(t.cv("ridge"), "model")


@query("cv_rmse", None, ops="M9")
def q_cv_rmse(c):
    return training(c).cv("ridge")


def train_all(c):
    """M8: every registry model with its five-fold RMSE; the best by test R², the earlier in the registry on a tie."""
    t, out = training(c), None
    for place, spec in enumerate(M.REGISTRY):
        cv = t.cv(spec.name)  # before the fit, which it brings along for boosters
        row = t.scores(spec.name).withColumn("place", F.lit(place)).join(cv, "model", "left")
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.min(F.struct((-F.col("r2")).alias("r"), "place"))["place"].alias("p")).scalar()
    return out.withColumn("is_best", F.col("place") == best).drop("place")


@query("train_all", None, ops="M8 O9")
def q_train_all(c):
    return train_all(c)


@query("comparison_table", None, ops="M11")
def q_comparison_table(c):
    t = train_all(c)
    return t.select("model", np_round("r2", 4).alias("r2"), np_round("rmse", 1).alias("rmse"),
                    np_round("mae", 1).alias("mae"), np_round("mape", 2).alias("mape"),
                    np_round("cv_rmse_mean", 1).alias("cv_rmse_mean"), np_round("cv_rmse_std", 1).alias("cv_rmse_std"),
                    "fit_seconds", "is_best").orderBy(F.desc("r2"))


@query("model_ranking", None, ops="W5")
def q_model_ranking(c):
    from pyspark.sql import Window
    t = train_all(c)
    # one row per registry model: a global window over five rows
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "model")))


@query("coef_importance", None, ops="M12")
def q_coef_importance(c):
    model, _ = training(c).fit("ridge")
    return M.coef_importance(model, train_test(c)[0], 20)


@query("tree_importance", None, ops="M13")
def q_tree_importance(c):
    return M.tree_importance(training(c).fit("random_forest")[0], 20)


#: The proxy forest for importances: 100 trees of depth 8 on every row.
PROXY = M.ModelSpec("rf_proxy", "random_forest", {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 1})


@query("rf_proxy_importance", None, ops="M14")
def q_rf_proxy_importance(c):
    data = assembled(c)
    model, _ = M.fit(PROXY, data)
    pred = M.predictions(model, data)
    r2 = M.regression_metrics(pred, "actual", "predicted").select("r2").scalar()
    return M.tree_importance(model, len(D.FEATURES)).withColumn("train_r2", r2)


@query("predictions", None, ops="M15")
def q_predictions(c):
    model, _ = training(c).fit("ridge")
    return M.predictions(model, train_test(c)[1], keep=["k"])


# ---------------------------------------------------------------------------
# PCA
# ---------------------------------------------------------------------------

def _pca(c):
    t = training(c)
    if not hasattr(t, "pca"):
        t.pca = M.fit_pca(t.table)
    return t.table, t.pca


@query("pca_variance", None, ops="X10 W3")
def q_pca_variance(c):
    _, model = _pca(c)
    return M.pca_variance(model)


@query("pca_loadings", None, ops="X11")
def q_pca_loadings(c):
    _, model = _pca(c)
    return M.pca_loadings(model)


@query("pca_scores", None, ops="X12")
def q_pca_scores(c):
    a, model = _pca(c)
    n = a.count()
    # the scaler divides by the sample std; the published scores by the population std
    scale = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    arr = vector_to_array(F.col("pcs"))
    return model.transform(a).select("k", *[(arr[i] * F.lit(scale)).alias(f"pc{i + 1}") for i in range(len(D.FEATURES))])


@query("pca_table", None, ops="X13 O9")
def q_pca_table(c):
    a, model = _pca(c)
    n = a.count()
    # eigenvalues of data scaled by the population std are n / (n - 1) times those of the sample std
    return M.pca_table(model, M.scaled_variance(model) * n / max(n - 1, 1))


@query("effective_rank", None, ops="X14 W4")
def q_effective_rank(c):
    _, model = _pca(c)
    return M.effective_rank(model)


@query("feature_ranking", None, ops="X15 W2")
def q_feature_ranking(c):
    from harvestry.operators import profiling as X
    rf, _ = training(c).fit("random_forest")
    imp = M.tree_importance(rf, len(D.FEATURES)).select("feature", "importance")
    corr = X.corr_with_target(c.features, D.FEATURES, D.TARGET).select("feature", "abs_r")
    mi = X.mutual_information(c.features, D.FEATURES, D.TARGET)
    t = corr.join(F.broadcast(mi), "feature").join(F.broadcast(imp), "feature")  # 36 rows each
    return mean_rank(t, "feature", ["abs_r", "mi", "importance"])


# ---------------------------------------------------------------------------
# model artefacts (sinks)
# ---------------------------------------------------------------------------

@query("model_roundtrip", None, ops="S13")
def q_model_roundtrip(c):
    model, te = training(c).fit("ridge")[0], train_test(c)[1]
    path = shared_path(c.spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = M.predictions(model, te, keep=["k"]).select("k", F.col("predicted").alias("p_fitted"))
    b = M.predictions(loaded, te, keep=["k"]).select("k", F.col("predicted").alias("p_loaded"))
    return a.join(b, "k").withColumn("equal", F.col("p_fitted") == F.col("p_loaded"))


@query("model_runs_table", None, ops="S14")
def q_model_runs_table(c):
    """The run log after one run per model: the settings of the fitted models and their seven metrics."""
    for spec in M.REGISTRY:
        log = _log(c, spec.name)
    return read_runs(c.spark, log)


@query("pca_outputs", None, ops="S16")
def q_pca_outputs(c):
    _, model = _pca(c)
    path = shared_path(c.spark, "pca")
    M.pca_loadings(model).write.mode("overwrite").parquet(f"{path}/loadings")
    M.effective_rank(model).write.mode("overwrite").json(f"{path}/metrics")
    return c.spark.read.parquet(f"{path}/loadings")


@query("model_summary", None, ops="S17")
def q_model_summary(c):
    t = train_all(c)
    best = t.where("is_best").select(F.col("model").alias("best_model"))
    nested = t.agg(F.collect_list(F.struct("model", "r2", "rmse", "mae", "mape")).alias("models"))
    tr, te = train_test(c)
    summary = best.select("best_model", nested.select("models").scalar().alias("models"),
                          tr.agg(F.count(F.lit(1))).scalar().alias("n_train"),
                          te.agg(F.count(F.lit(1))).scalar().alias("n_test"))
    path = shared_path(c.spark, "model_summary")
    summary.write.mode("overwrite").json(path)
    return c.spark.read.json(path)


# ---------------------------------------------------------------------------
# what-if queries with the models that training produced
# ---------------------------------------------------------------------------

def _register_fitted(name, label):
    def model(c):
        return training(c).scorer(name)

    query(f"predict_{label}", None, ops="R1")(lambda c: R.predict_yield(c.scenarios, model(c)))
    query(f"recommend_{label}", None, ops="R2 W1")(lambda c: R.recommend_crops(c.scenarios, model(c)))
    query(f"optimize_{label}", None, ops="R3 R4")(lambda c: R.optimize_best(c.scenarios, model(c)))
    query(f"compare_{label}", None, ops="R6")(lambda c: R.compare_scenarios(c.scenarios, model(c)))


_register_fitted("ridge", "fitted_ridge")
query("sensitivity_fitted_ridge", None, ops="R7 R8")(
    lambda c: R.sensitivity(c.scenarios, training(c).scorer("ridge"), "rainfall_mm", 100, 1550, 50))
_register_fitted("hist_gradient_boosting", "fitted_booster")
