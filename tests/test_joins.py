"""The merge and lookup joins take any lookup; the planner sizes the sides."""

from harvestry.functions import domains as D
from harvestry.operators import joins as J


def test_duplicate_and_multi_year_lookup_rows_fan_out(spark):
    obs = spark.createDataFrame([("Maize", "East", "Clay", "Sunny", 500.0, 20.0, True, False, 100, 3.0)],
                                "crop string, region string, soil_type string, weather_condition string, rainfall_mm double, "
                                "temperature_celsius double, fertilizer_used boolean, irrigation_used boolean, days_to_harvest int, "
                                "yield_tons_per_hectare double")
    lookup = spark.createDataFrame([("Maize", 2000, 1.0, 2.0, 3.0, 4.0), ("Maize", 2001, 1.0, 2.0, 3.0, 4.0), ("Maize", 2001, 1.0, 2.0, 3.0, 4.0)],
                                   "crop string, year int, fao_yield_hg_ha double, fao_rainfall_mm double, fao_pesticides_tonnes double, fao_avg_temp double")
    out = J.merge_datasets(obs, lookup)
    assert out.columns == D.MERGED_COLUMNS and sorted(r.year for r in out.collect()) == [2000, 2001, 2001]
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()


def test_constants_are_pinned():
    assert D.CROPS == ["Maize", "Rice", "Soybean", "Wheat"] and len(D.FEATURES) == 36
    assert D.CROP_OPTIMAL_RAINFALL_MM == {"Maize": 650.0, "Rice": 1200.0, "Soybean": 600.0, "Wheat": 500.0}
    assert D.CROP_MAX_TEMP_C == {"Maize": 32.0, "Rice": 35.0, "Soybean": 32.0, "Wheat": 25.0}
    assert D.CROP_BASE_TEMP_C == {"Maize": 10.0, "Rice": 10.0, "Soybean": 6.0, "Wheat": 0.0}
    assert D.BENCHMARK_YIELD_HG_HA == {"Maize": 99256, "Rice": 86232, "Soybean": 29615, "Wheat": 31673}
    assert D.SOIL_QUALITY_SCORE == {"Loam": 5, "Silt": 4, "Clay": 3, "Peaty": 3, "Chalky": 2, "Sandy": 1}
    assert D.GRID_DAYS == list(range(60, 210, 10)) and D.SWEEP_RAINFALL == (100, 1550, 50) and D.SWEEP_TEMPERATURE == (5, 41, 1)


def test_scenarios_are_joined_without_sorting(spark, catalog):
    """Where the parts are not broadcast, their partitions are hashed: the observations are neither sorted nor spilled."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.scenarios.select(F.xxhash64("scenario_id", "soil_type").alias("h"))
        n = len(df.collect())
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n == catalog.scenarios.count() and "ShuffledHashJoin" in final and "SortMergeJoin" not in final
