"""The 36 model features (F1–F19) as Column expressions.

``feature_columns`` takes Column inputs, so one definition serves
* the batch table (``build_features`` over the merged table), and
* scenario scoring, where the inputs are lambda variables of a
  ``transform`` over a crop list or a management grid.

``feature_sql`` is the same arithmetic written for the DuckDB oracle.
Divisions by zero give 0.0 in both (the serving rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import case_map, clip_lower, np_round, sql_case_map, sql_double, sql_np_round


def feature_columns(
    r: Column, t: Column, d: Column, fert: Column, irri: Column,
    crop: Column, region: Column, soil: Column, weather: Column,
    bench_yield: Column, ref_rain: Column, ref_temp: Column,
) -> dict[str, Column]:
    """Ordered mapping feature name -> expression (keys in ``D.FEATURES`` order)."""
    fi = fert.cast("int")
    ii = irri.cast("int")
    opt = case_map(crop, D.CROP_OPTIMAL_RAINFALL_MM)
    tmax = case_map(crop, D.CROP_MAX_TEMP_C)
    tbase = case_map(crop, D.CROP_BASE_TEMP_C)
    out: dict[str, Column] = {
        "rainfall_mm": r,
        "temperature_celsius": t,
        "fertilizer_used": fi,
        "irrigation_used": ii,
        "days_to_harvest": d.cast("int"),
        "fao_yield_hg_ha": bench_yield.cast("double"),
        "rainfall_anomaly": np_round(r - ref_rain, 3),
        "temp_anomaly": np_round(t - ref_temp, 3),
        "rainfall_x_fertilizer": np_round(r * fi, 3),
        "rainfall_x_irrigation": np_round(r * ii, 3),
        "temp_x_irrigation": np_round(t * ii, 3),
        "agro_intensity": fi + ii,
        "heat_moisture_ratio": F.when(r == 0, F.lit(0.0)).otherwise(np_round(t / (r / F.lit(100.0)), 4)),
        "aridity_index": F.when(t == 0, F.lit(0.0)).otherwise(np_round(r / t, 4)),
        "harvest_rainfall_rate": F.when(d == 0, F.lit(0.0)).otherwise(np_round(r / d, 4)),
        "water_stress": np_round(F.abs(r - opt) / opt, 4),
        "heat_stress": np_round(clip_lower(t - tmax, 0.0), 3),
        "gdd_proxy": np_round(clip_lower(t - tbase, 0.0) * d, 1),
        "soil_quality_score": case_map(soil, D.SOIL_QUALITY_SCORE).cast("int"),
    }
    for name, c in (("crop", crop), ("region", region), ("soil_type", soil), ("weather_condition", weather)):
        for v in dict(D.ONE_HOT_DOMAINS)[name]:
            out[f"{name}_{v}"] = F.when(c == F.lit(v), F.lit(1)).otherwise(F.lit(0))
    return out


def feature_sql(
    r: str, t: str, d: str, fert: str, irri: str, crop: str, region: str, soil: str, weather: str,
    bench_yield: str, ref_rain: str, ref_temp: str,
) -> dict[str, str]:
    fi, ii = f"cast({fert} as int)", f"cast({irri} as int)"
    opt = sql_case_map(crop, D.CROP_OPTIMAL_RAINFALL_MM)
    tmax = sql_case_map(crop, D.CROP_MAX_TEMP_C)
    tbase = sql_case_map(crop, D.CROP_BASE_TEMP_C)

    def clip0(x):
        return f"(case when ({x}) is null then null else greatest(({x}), 0.0e0) end)"

    out = {
        "rainfall_mm": r,
        "temperature_celsius": t,
        "fertilizer_used": fi,
        "irrigation_used": ii,
        "days_to_harvest": f"cast({d} as int)",
        "fao_yield_hg_ha": f"cast({bench_yield} as double)",
        "rainfall_anomaly": sql_np_round(f"{r} - {ref_rain}", 3),
        "temp_anomaly": sql_np_round(f"{t} - {ref_temp}", 3),
        "rainfall_x_fertilizer": sql_np_round(f"{r} * {fi}", 3),
        "rainfall_x_irrigation": sql_np_round(f"{r} * {ii}", 3),
        "temp_x_irrigation": sql_np_round(f"{t} * {ii}", 3),
        "agro_intensity": f"({fi} + {ii})",
        "heat_moisture_ratio": f"(case when {r} = 0 then 0.0e0 else {sql_np_round(f'{t} / ({r} / 100.0e0)', 4)} end)",
        "aridity_index": f"(case when {t} = 0 then 0.0e0 else {sql_np_round(f'{r} / {t}', 4)} end)",
        "harvest_rainfall_rate": f"(case when {d} = 0 then 0.0e0 else {sql_np_round(f'{r} / {d}', 4)} end)",
        "water_stress": sql_np_round(f"abs({r} - {opt}) / {opt}", 4),
        "heat_stress": sql_np_round(clip0(f"{t} - {tmax}"), 3),
        "gdd_proxy": sql_np_round(f"{clip0(f'{t} - {tbase}')} * {d}", 1),
        "soil_quality_score": f"cast({sql_case_map(soil, D.SOIL_QUALITY_SCORE)} as int)",
    }
    for name, c in (("crop", crop), ("region", region), ("soil_type", soil), ("weather_condition", weather)):
        for v in dict(D.ONE_HOT_DOMAINS)[name]:
            out[f"{name}_{v}"] = f"(case when {c} = '{v}' then 1 else 0 end)"
    return out


# ---------------------------------------------------------------------------
# batch: merged table -> feature table
# ---------------------------------------------------------------------------

def merged_feature_columns(df: DataFrame | None = None) -> dict[str, Column]:
    c = F.col
    return feature_columns(
        c("rainfall_mm"), c("temperature_celsius"), c("days_to_harvest"),
        c("fertilizer_used"), c("irrigation_used"), c("crop"), c("region"),
        c("soil_type"), c("weather_condition"), c("fao_yield_hg_ha"),
        c("fao_rainfall_mm"), c("fao_avg_temp"))


def merged_feature_sql(alias: str = "") -> dict[str, str]:
    a = f"{alias}." if alias else ""
    return feature_sql(
        f"{a}rainfall_mm", f"{a}temperature_celsius", f"{a}days_to_harvest",
        f"{a}fertilizer_used", f"{a}irrigation_used", f"{a}crop", f"{a}region",
        f"{a}soil_type", f"{a}weather_condition", f"{a}fao_yield_hg_ha",
        f"{a}fao_rainfall_mm", f"{a}fao_avg_temp")


def build_features(merged: DataFrame, features: list[str] | None = None,
                   keep: list[str] | None = None, target: str | None = D.TARGET) -> DataFrame:
    """36 features (or a named subset) plus the target, one projection."""
    exprs = merged_feature_columns()
    names = features or D.FEATURES
    cols = [F.col(k) for k in (keep or [])] + [exprs[n].alias(n) for n in names]
    if target:
        cols.append(F.col(target))
    return merged.select(*cols)


# ---------------------------------------------------------------------------
# serving: conditions + crop -> features against the fixed benchmarks
# ---------------------------------------------------------------------------

def serving_feature_columns(r, t, d, fert, irri, crop, region, soil, weather) -> dict[str, Column]:
    bench = case_map(crop, {k: float(v) for k, v in D.BENCHMARK_YIELD_HG_HA.items()})
    return feature_columns(r, t, d, fert, irri, crop, region, soil, weather, bench,
                           F.lit(D.BENCHMARK_RAINFALL_MM), F.lit(D.BENCHMARK_AVG_TEMP))


def serving_feature_sql(r, t, d, fert, irri, crop, region, soil, weather) -> dict[str, str]:
    bench = sql_case_map(crop, {k: float(v) for k, v in D.BENCHMARK_YIELD_HG_HA.items()})
    return feature_sql(r, t, d, fert, irri, crop, region, soil, weather, bench,
                       sql_double(D.BENCHMARK_RAINFALL_MM), sql_double(D.BENCHMARK_AVG_TEMP))


# ---------------------------------------------------------------------------
# linear scoring (prediction = intercept + sum coef * (x - mean) / std, clipped at 0)
# ---------------------------------------------------------------------------

def linear_score(feats: dict[str, Column], coefs: list[tuple[str, float, float, float]],
                 intercept: float, clip: bool = True) -> Column:
    """Catalyst expression of a standardised linear model, summed in feature order."""
    acc = F.lit(float(intercept))
    for name, mean, std, coef in coefs:
        if coef == 0.0:
            continue
        acc = acc + F.lit(float(coef)) * ((feats[name] - F.lit(float(mean))) / F.lit(float(std)))
    return F.greatest(acc, F.lit(0.0)) if clip else acc


def linear_score_sql(feats: dict[str, str], coefs, intercept: float, clip: bool = True) -> str:
    acc = sql_double(intercept)
    for name, mean, std, coef in coefs:
        if coef == 0.0:
            continue
        acc = f"({acc} + {sql_double(coef)} * (({feats[name]} - {sql_double(mean)}) / {sql_double(std)}))"
    return f"greatest({acc}, 0.0e0)" if clip else acc
