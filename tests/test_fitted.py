"""What-if operators with saved and loaded fitted models against row-by-row transform."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.features import build_features
from harvestry.operators import fitted as X
from harvestry.operators import models as M
from harvestry.operators import scoring as R
from harvestry.operators.validation import valid_condition
from harvestry.plans.catalog import Catalog
from harvestry.session import shared_path
from tests.conftest import SF_SMALL

SMALL_BOOSTER = M.ModelSpec("b", "gbt", {"n_estimators": 8, "learning_rate": 0.3, "max_depth": 5, "max_leaves": 12, "min_samples_leaf": 5})
SMALL_FOREST = M.ModelSpec("f", "random_forest", {"n_estimators": 6, "max_depth": 8, "min_samples_leaf": 5})


@pytest.fixture(scope="module")
def small(spark):
    return Catalog(spark, SF_SMALL)


@pytest.fixture(scope="module")
def scenarios(spark, small):
    path = shared_path(spark, "fitted-scenarios")
    small.scenarios.orderBy("scenario_id", "crop").limit(150).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module", params=[M.SPECS["ridge"], SMALL_BOOSTER, SMALL_FOREST], ids=lambda s: s.name)
def saved(request, spark, small):
    """(path, model as fitted) of a model saved after training on the merged table."""
    key = F.monotonically_increasing_id().cast("string").alias("k")
    train = M.assemble(build_features(small.merged.select(key, *D.MERGED_COLUMNS), keep=["k"]), "k")
    model, _ = M.fit(request.param, train)
    path = shared_path(spark, "fitted-model")
    X.save_model(spark, model, path)
    return path, model


def by_transform(model, rows):
    """{key: prediction} of the fitted model itself on each candidate's feature vector."""
    keep = [c for c in rows.columns if c.startswith("id_")]
    out = model.transform(X.candidate_vectors(rows, keep)).collect()
    return {tuple(r[k] for k in keep): max(r["prediction"], 0.0) for r in out}


def test_recommend_equals_transform(spark, scenarios, saved):
    path, model = saved
    got = R.recommend_crops(scenarios, X.load_scorer(spark, path)).collect()
    crops = F.explode(F.array(*[F.lit(c) for c in D.CROPS]))
    plain = by_transform(model, scenarios.where(valid_condition()).drop("crop").distinct().withColumn("crop", crops)
                         .withColumns({"id_s": F.col("scenario_id"), "id_c": F.col("crop")}))
    assert len(got) > 400 and len({(r.scenario_id, r.crop) for r in got}) == len(plain)
    for r in got:
        assert abs(r.predicted_yield_hg_ha - plain[r.scenario_id, r.crop]) <= 0.05 + 1e-9
    order = {}
    for r in got:
        order.setdefault(r.scenario_id, {})[r["rank"]] = (-r.predicted_yield_hg_ha, D.CROPS.index(r.crop))
    assert all([ranks[i] for i in sorted(ranks)] == sorted(ranks.values()) for ranks in order.values())


def test_optimize_equals_transform_of_every_grid_point(spark, scenarios, saved):
    path, model = saved
    some = scenarios.limit(12)
    got = {(r.scenario_id, r.crop): r for r in R.optimize_best(some, X.load_scorer(spark, path)).collect()}
    base = some.where(valid_condition(check_crop=True))
    grid = (base.drop("fertilizer_used", "irrigation_used", "days_to_harvest")
            .withColumn("fertilizer_used", F.explode(F.array(F.lit(True), F.lit(False))))
            .withColumn("irrigation_used", F.explode(F.array(F.lit(True), F.lit(False))))
            .withColumn("days_to_harvest", F.explode(F.array(*[F.lit(d) for d in D.GRID_DAYS])))
            .withColumns({"id_s": F.col("scenario_id"), "id_c": F.col("crop"), "id_f": F.col("fertilizer_used"),
                          "id_i": F.col("irrigation_used"), "id_d": F.col("days_to_harvest")}))
    points = by_transform(model, grid)
    assert got and len(points) == 60 * len(got)
    for key, r in got.items():
        ranked = sorted((-np.round(p, 1), not f, not i, d) for (s, c, f, i, d), p in points.items() if (s, c) == key)
        best, fert, irri, days = ranked[0]
        assert abs(r.best_yield_hg_ha + best) < 1e-6
        assert (r.best_fertilizer_used, r.best_irrigation_used, r.best_days_to_harvest) == (not fert, not irri, days)


def test_all_what_if_operators_take_a_loaded_model(spark, scenarios, saved):
    model = X.load_scorer(spark, saved[0])
    some = scenarios.limit(10)
    valid = some.where(valid_condition(check_crop=True)).count()
    best = R.optimize_best(some, model)
    assert R.predict_yield(some, model).count() == valid == best.count()
    assert R.optimize_curve(some, model).count() == 60 * valid
    assert R.predict_vs_benchmark(some, model).count() == valid and R.gain_breakdown(best).count() == 3 * valid
    assert R.compare_scenarios(some, model).count() == some.where(valid_condition()).count()
    assert R.sensitivity(some, model, "rainfall_mm", 100, 300, 50).count() == 5 * len(D.CROPS)


def test_ridge_equals_sql_of_its_exported_coefficients(spark, scenarios, saved):
    import duckdb

    scorer = X.load_scorer(spark, saved[0])
    if not isinstance(scorer, R.LinearModel):
        pytest.skip("SQL of coefficients")
    valid = scenarios.where(valid_condition(check_crop=True))
    t = valid.toPandas()  # noqa: F841  read by DuckDB
    sql = duckdb.sql(f"select scenario_id, crop, {R.sql_np_round(R.sql_pred(scorer), 1)} as p from t").df()
    got = R.predict_yield(scenarios, scorer).toPandas()
    m = got.merge(sql, on=["scenario_id", "crop"])
    assert len(m) >= len(got) and (m.predicted_yield_hg_ha - m.p).abs().max() <= 0.1 + 1e-9


def test_other_pipelines_are_refused(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.linalg import Vectors
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([2.0, 1.0]),)], ["features"])
    with pytest.raises(ValueError):
        X.linear_of(Pipeline(stages=[PCA(k=1, inputCol="features", outputCol="p")]).fit(df))
