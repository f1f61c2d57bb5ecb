"""Closed category domains, agronomic constants and the feature order.

FIXED VALUES — these must equal the published model's definitions for the
results to agree; they are stated plainly and in their natural order.
"""

from __future__ import annotations

# --- fixed values: category domains ------------------------------------------
CROPS = ["Maize", "Rice", "Soybean", "Wheat"]
REGIONS = ["East", "North", "South", "West"]
SOIL_TYPES = ["Chalky", "Clay", "Loam", "Peaty", "Sandy", "Silt"]
WEATHER_CONDITIONS = ["Cloudy", "Rainy", "Sunny"]

# --- fixed values: agronomic constants per crop ------------------------------
CROP_OPTIMAL_RAINFALL_MM = {"Maize": 650.0, "Rice": 1200.0, "Soybean": 600.0, "Wheat": 500.0}
CROP_MAX_TEMP_C = {"Maize": 32.0, "Rice": 35.0, "Soybean": 32.0, "Wheat": 25.0}
CROP_BASE_TEMP_C = {"Maize": 10.0, "Rice": 10.0, "Soybean": 6.0, "Wheat": 0.0}
SOIL_QUALITY_SCORE = {"Loam": 5, "Silt": 4, "Clay": 3, "Peaty": 3, "Chalky": 2, "Sandy": 1}

# --- fixed values: reference-year benchmarks ----------------------------------
BENCHMARK_YIELD_HG_HA = {"Maize": 99256, "Rice": 86232, "Soybean": 29615, "Wheat": 31673}
BENCHMARK_RAINFALL_MM = 715.0
BENCHMARK_AVG_TEMP = 16.44

# --- fixed values: reference-item names and their observation crop -----------
FAO_TO_CROP = {"Maize": "Maize", "Rice, paddy": "Rice", "Soybeans": "Soybean", "Wheat": "Wheat"}

# --- fixed values: validation bounds -----------------------------------------
# engine check: rain >= 0, -10 <= temp <= 50, days > 0
# request check: 0 <= rain <= 5000, -10 <= temp <= 50, 1 <= days <= 365
RAIN_MAX_MM = 5000.0
TEMP_MIN_C, TEMP_MAX_C = -10.0, 50.0
DAYS_MIN, DAYS_MAX = 1, 365

# --- fixed values: optimiser grid ---------------------------------------------
GRID_FERTILIZER = [True, False]
GRID_IRRIGATION = [True, False]
GRID_DAYS = list(range(60, 210, 10))  # 60, 70, ..., 200

# --- fixed values: sensitivity sweeps ----------------------------------------
SWEEP_RAINFALL = (100, 1550, 50)     # start, stop (inclusive), step
SWEEP_TEMPERATURE = (5, 41, 1)

# --- fixed values: the 36 model features, in the model's order ----------------
SCALAR_FEATURES = [
    "rainfall_mm", "temperature_celsius", "fertilizer_used", "irrigation_used",
    "days_to_harvest", "fao_yield_hg_ha", "rainfall_anomaly", "temp_anomaly",
    "rainfall_x_fertilizer", "rainfall_x_irrigation", "temp_x_irrigation",
    "agro_intensity", "heat_moisture_ratio", "aridity_index",
    "harvest_rainfall_rate", "water_stress", "heat_stress", "gdd_proxy",
    "soil_quality_score",
]
ONE_HOT_DOMAINS = [
    ("crop", CROPS),
    ("region", REGIONS),
    ("soil_type", SOIL_TYPES),
    ("weather_condition", WEATHER_CONDITIONS),
]
ONE_HOT_FEATURES = [f"{name}_{v}" for name, dom in ONE_HOT_DOMAINS for v in dom]
FEATURES = SCALAR_FEATURES + ONE_HOT_FEATURES
INT_FEATURES = {"fertilizer_used", "irrigation_used", "days_to_harvest", "agro_intensity",
                "soil_quality_score", *ONE_HOT_FEATURES}
TARGET = "yield_hg_ha"

# Column order of the merged analysis table.
# --- fixed values: columns of the merged table and of a scenario's conditions --
MERGED_COLUMNS = [
    "crop", "year", "region", "soil_type", "weather_condition", "rainfall_mm",
    "temperature_celsius", "fertilizer_used", "irrigation_used", "days_to_harvest",
    "yield_hg_ha", "fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes",
    "fao_avg_temp",
]
CONDITION_COLUMNS = [
    "rainfall_mm", "temperature_celsius", "days_to_harvest", "region", "soil_type",
    "weather_condition", "fertilizer_used", "irrigation_used",
]
