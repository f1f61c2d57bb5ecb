"""Scoring, ranking and optimisation: spot values of the fixture model and
the reference engine's properties (ranks, stresses, units, optimiser)."""

import pytest
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.operators import scoring as R
from harvestry.sources import fixtures as FX

MODEL = R.LinearModel(FX.coef_rows(), FX.COEF_INTERCEPT)


@pytest.fixture(scope="module")
def presets(spark):
    return FX.scenario_presets_df(spark)


@pytest.fixture(scope="module")
def ranked(presets):
    return R.recommend_crops(presets, MODEL).toPandas()


def test_spot_values(ranked):
    top = ranked[ranked["rank"] == 1].set_index("scenario_id")
    assert (top.loc["S1", "crop"], top.loc["S1", "predicted_yield_hg_ha"]) == ("Maize", 67264.9)
    assert (top.loc["S4", "crop"], top.loc["S4", "predicted_yield_hg_ha"]) == ("Rice", 98082.7)
    assert (top.loc["S7", "crop"], top.loc["S7", "predicted_yield_hg_ha"]) == ("Maize", 1141.3)


def test_ranking_properties(ranked):
    for _, g in ranked.groupby("scenario_id"):
        assert sorted(g["rank"]) == [1, 2, 3, 4]
        assert sorted(g["crop"]) == D.CROPS
        g = g.sort_values("rank")
        assert list(g["predicted_yield_hg_ha"]) == sorted(g["predicted_yield_hg_ha"], reverse=True)
    assert (ranked["water_stress"] >= 0).all() and (ranked["heat_stress"] >= 0).all()
    assert (ranked["fao_benchmark_hg_ha"] > 0).all()
    assert ((ranked["predicted_yield_t_ha"] - ranked["predicted_yield_hg_ha"] / 10000).abs() < 1e-3).all()


def test_ties_rank_in_crop_order(presets):
    flat = R.LinearModel([(f, 0.0, 1.0, 0.0) for f in D.FEATURES], 50000.0)
    out = R.recommend_crops(presets.where("scenario_id = 'S1'"), flat).orderBy("rank").toPandas()
    assert list(out["crop"]) == D.CROPS


def test_optimiser_spot_and_ties(presets):
    best = R.optimize_best(presets, MODEL).toPandas().set_index("scenario_id")
    s1 = best.loc["S1"]
    assert (s1["crop"], s1["best_fertilizer_used"], s1["best_irrigation_used"], s1["best_days_to_harvest"],
            s1["best_yield_hg_ha"]) == ("Maize", True, True, 60, 67389.0)
    flat = R.LinearModel([(f, 0.0, 1.0, 0.0) for f in D.FEATURES], 50000.0)
    t = R.optimize_best(presets, flat).toPandas()
    assert t["best_fertilizer_used"].all() and t["best_irrigation_used"].all()
    assert (t["best_days_to_harvest"] == 60).all()


def test_best_not_below_baseline_on_grid(presets):
    best = R.optimize_best(presets, MODEL).toPandas().set_index("scenario_id")
    on_grid = [s for s, r in zip(best.index, best["scenario_id"] if "scenario_id" in best else best.index)
               if s != "S5"]  # S5 has 240 days: off the grid
    for s in on_grid:
        assert best.loc[s, "best_yield_hg_ha"] >= best.loc[s, "baseline_yield_hg_ha"] - 0.1


def test_rainfall_monotone(spark):
    rows = [("lo", "Maize", 100.0, 22.0, 120, "East", "Loam", "Sunny", True, True),
            ("hi", "Maize", 2000.0, 22.0, 120, "East", "Loam", "Sunny", True, True)]
    df = spark.createDataFrame(rows, ",".join(f"{c} {t}" for c, t in zip(
        FX.SCENARIO_COLUMNS, ["string", "string", "double", "double", "int", "string", "string", "string",
                              "boolean", "boolean"])))
    p = {r.scenario_id: r.predicted_yield_hg_ha for r in R.predict_yield(df, MODEL).collect()}
    assert p["hi"] > p["lo"]


def test_feature_parity_batch_vs_serving(spark):
    """A scenario scored through the batch feature table equals the serving path."""
    from harvestry.functions.features import build_features
    row = spark.createDataFrame(
        [("Maize", 650.0, 22.0, 120, "East", "Loam", "Sunny", True, True, 1.0,
          float(D.BENCHMARK_YIELD_HG_HA["Maize"]), D.BENCHMARK_RAINFALL_MM, D.BENCHMARK_AVG_TEMP)],
        "crop string, rainfall_mm double, temperature_celsius double, days_to_harvest int, region string, "
        "soil_type string, weather_condition string, fertilizer_used boolean, irrigation_used boolean, "
        "yield_hg_ha double, fao_yield_hg_ha double, fao_rainfall_mm double, fao_avg_temp double")
    batch = build_features(row).first().asDict()
    serving = row.select(*[e.alias(n) for n, e in R.scenario_features(F.col("crop")).items()]).first().asDict()
    for f in D.FEATURES:
        assert float(batch[f]) == float(serving[f]), f
