"""Queries: scoring, recommendation, optimisation and what-if sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import sql_np_round
from harvestry.operators import scoring as R
from harvestry.operators.validation import sql_condition_reasons
from harvestry.plans.registry import query, view
from harvestry.sources import fixtures as FX

MODEL = R.LinearModel(FX.coef_rows(), FX.COEF_INTERCEPT)
_CROPS_SQL = "(select unnest([" + ", ".join(f"'{c}'" for c in D.CROPS) + "]) as k_crop)"
_GRID_SQL = ("(select f as g_fert, i as g_irri, d as g_days from (select unnest([true, false]) as f), "
             "(select unnest([true, false]) as i), (select cast(unnest(range(60, 210, 10)) as int) as d))")

view("valid_scen", f"select * from scenarios where {sql_condition_reasons()} = ''")
view("valid_scen_crop", f"select * from scenarios where {sql_condition_reasons(check_crop=True)} = ''")

_P = R.sql_pred(MODEL)
_P_K = R.sql_pred(MODEL, crop="k_crop")


def _model(c):
    return MODEL


@query("predict_yield", f"""
select scenario_id, crop, {sql_np_round(_P, 1)} as predicted_yield_hg_ha, {R.sql_t(_P)} as predicted_yield_t_ha
from valid_scen_crop""", ops="R1 P21 P12 F19")
def q_predict_yield(c):
    return R.predict_yield(c.scenarios, _model(c))


_RANK_SQL = f"""
with x as (select s.scenario_id, k.k_crop as crop, {_P_K} as p, s.rainfall_mm as r, s.temperature_celsius as t
           from valid_scen s, {_CROPS_SQL} k)
select scenario_id,
  cast(row_number() over (partition by scenario_id order by {sql_np_round('p', 1)} desc, crop) as int) as rank,
  crop, {sql_np_round('p', 1)} as predicted_yield_hg_ha, {R.sql_t('p')} as predicted_yield_t_ha,
  {sql_np_round("abs(r - case crop " + " ".join(f"when '{k}' then {v}e0" for k, v in D.CROP_OPTIMAL_RAINFALL_MM.items()) + " end) / case crop " + " ".join(f"when '{k}' then {v}e0" for k, v in D.CROP_OPTIMAL_RAINFALL_MM.items()) + " end", 4)} as water_stress,
  {sql_np_round("greatest(t - case crop " + " ".join(f"when '{k}' then {v}e0" for k, v in D.CROP_MAX_TEMP_C.items()) + " end, 0.0e0)", 3)} as heat_stress,
  case crop {" ".join(f"when '{k}' then {float(v)}e0" for k, v in D.BENCHMARK_YIELD_HG_HA.items())} end as fao_benchmark_hg_ha
from x"""
view("ranked_crops", _RANK_SQL.strip())


@query("recommend_crops", "select * from ranked_crops", ops="R2 J5 W1 Q10")
def q_recommend_crops(c):
    return R.recommend_crops(c.scenarios, _model(c))


@query("rank_crops", "select scenario_id, rank, crop, predicted_yield_hg_ha from ranked_crops", ops="W1")
def q_rank_crops(c):
    return R.recommend_crops(c.scenarios, _model(c)).select("scenario_id", "rank", "crop", "predicted_yield_hg_ha")


@query("compare_scenarios", """
select scenario_id, max(case when rank = 1 then crop end) as top_crop,
  max(case when rank = 1 then predicted_yield_hg_ha end) as top_yield_hg_ha,
  string_agg(crop, '>' order by rank) as ranking
from ranked_crops group by scenario_id""", ops="R6")
def q_compare_scenarios(c):
    return R.compare_scenarios(c.scenarios, _model(c))


_GRID_P = R.sql_pred(MODEL, fert="g.g_fert", irri="g.g_irri", days="g.g_days")
view("grid_scored", f"""
select s.scenario_id, s.crop, g.g_fert as fertilizer_used, g.g_irri as irrigation_used, g.g_days as days_to_harvest,
  {_GRID_P} as p, {_P.replace('fertilizer_used', 's.fertilizer_used').replace('irrigation_used', 's.irrigation_used').replace('days_to_harvest', 's.days_to_harvest')} as base_p
from valid_scen_crop s, {_GRID_SQL} g""")
view("grid_best", f"""
select * from (select *, row_number() over (partition by scenario_id, crop order by {sql_np_round('p', 1)} desc,
  fertilizer_used desc, irrigation_used desc, days_to_harvest asc) as rn from grid_scored) where rn = 1""")
view("opt_best", f"""
select scenario_id, crop, fertilizer_used as best_fertilizer_used, irrigation_used as best_irrigation_used,
  days_to_harvest as best_days_to_harvest, {sql_np_round('p', 1)} as best_yield_hg_ha, {R.sql_t('p')} as best_yield_t_ha,
  {sql_np_round('base_p', 1)} as baseline_yield_hg_ha, {R.sql_t('base_p')} as baseline_yield_t_ha,
  {sql_np_round(sql_np_round('p', 1) + ' - base_p', 1)} as yield_gain_hg_ha,
  case when base_p > 0 then {sql_np_round('(' + sql_np_round('p', 1) + ' - base_p) / base_p * 100.0e0', 2)} else 0.0e0 end
    as yield_gain_pct
from grid_best""")


@query("optimize_grid", """
select scenario_id, crop, best_fertilizer_used, best_irrigation_used, best_days_to_harvest, best_yield_hg_ha,
  best_yield_t_ha from opt_best""", ops="R3 J6 O9")
def q_optimize_grid(c):
    return R.optimize_best(c.scenarios, _model(c)).select(
        "scenario_id", "crop", "best_fertilizer_used", "best_irrigation_used", "best_days_to_harvest",
        "best_yield_hg_ha", "best_yield_t_ha")


@query("optimize_best", "select * from opt_best", ops="R4")
def q_optimize_best(c):
    return R.optimize_best(c.scenarios, _model(c))


@query("optimize_curve", f"""
select scenario_id, crop, fertilizer_used, irrigation_used, days_to_harvest,
  'Fert=' || case when fertilizer_used then 'True' else 'False' end || ' / Irri=' ||
  case when irrigation_used then 'True' else 'False' end as config,
  {sql_np_round('p', 1)} as predicted_yield_hg_ha, {R.sql_t('p')} as predicted_yield_t_ha
from grid_scored""", ops="R5 P17")
def q_optimize_curve(c):
    return R.optimize_curve(c.scenarios, _model(c))


@query("config_label", """
select distinct 'Fert=' || case when fertilizer_used then 'True' else 'False' end || ' / Irri=' ||
  case when irrigation_used then 'True' else 'False' end as config, fertilizer_used, irrigation_used
from farm_obs""", ops="P17")
def q_config_label(c):
    return c.farm_obs.select(R.config_label(F.col("fertilizer_used"), F.col("irrigation_used")).alias("config"),
                             "fertilizer_used", "irrigation_used").distinct()


@query("gain_breakdown", """
select scenario_id, crop, 1 as step_pos, 'baseline' as step, baseline_yield_hg_ha as value_hg_ha from opt_best
union all select scenario_id, crop, 2, 'gain', yield_gain_hg_ha from opt_best
union all select scenario_id, crop, 3, 'best', best_yield_hg_ha from opt_best""", ops="R10")
def q_gain_breakdown(c):
    return R.gain_breakdown(R.optimize_best(c.scenarios, _model(c)))


def _sweep_sql(column: str, start, stop, step) -> str:
    others = [x for x in D.CONDITION_COLUMNS if x != column]
    p = R.sql_pred(MODEL, crop="k_crop")
    return f"""
with s as (select {', '.join(others)}, cast(lv as double) as {column}
           from valid_scen, (select unnest(range({start}, {stop + step}, {step})) as lv)),
x as (select s.{column}, k.k_crop as crop, {p.replace('k_crop', 'k.k_crop')} as p from s, {_CROPS_SQL} k)
select {column}, crop, {sql_np_round('avg(p)', 4)} as mean_predicted_yield_hg_ha,
  {sql_np_round('min(p)', 4)} as min_predicted_yield_hg_ha, {sql_np_round('max(p)', 4)} as max_predicted_yield_hg_ha,
  count(*) as n_scenarios
from x group by {column}, crop"""


@query("sensitivity_rainfall", _sweep_sql("rainfall_mm", *D.SWEEP_RAINFALL), ops="R7")
def q_sensitivity_rainfall(c):
    return R.sensitivity(c.scenarios, _model(c), "rainfall_mm", *D.SWEEP_RAINFALL)


@query("sensitivity_temperature", _sweep_sql("temperature_celsius", *D.SWEEP_TEMPERATURE), ops="R8")
def q_sensitivity_temperature(c):
    return R.sensitivity(c.scenarios, _model(c), "temperature_celsius", *D.SWEEP_TEMPERATURE)


SEASON = ["region", "soil_type", "weather_condition"]


def base_seasons(c):
    """One season per region, soil and weather: mean rainfall, temperature and days, both inputs on."""
    from harvestry.functions.numeric import np_round
    from harvestry.operators.validation import valid_condition
    return c.scenarios.where(valid_condition()).groupBy(*SEASON).agg(
        np_round(F.avg("rainfall_mm"), 1).alias("rainfall_mm"), np_round(F.avg("temperature_celsius"), 1).alias("temperature_celsius"),
        np_round(F.avg("days_to_harvest"), 0).cast("int").alias("days_to_harvest"),
        F.lit(True).alias("fertilizer_used"), F.lit(True).alias("irrigation_used"))


view("base_seasons", f"""
select {', '.join(SEASON)}, {sql_np_round('avg(rainfall_mm)', 1)} as rainfall_mm, {sql_np_round('avg(temperature_celsius)', 1)} as temperature_celsius,
  cast({sql_np_round('avg(days_to_harvest)', 0)} as int) as days_to_harvest, true as fertilizer_used, true as irrigation_used
from valid_scen group by {', '.join(SEASON)}""")


def _curve_sql(column: str, start, stop, step) -> str:
    others = [x for x in D.CONDITION_COLUMNS if x != column]
    p = R.sql_pred(MODEL, crop="k.k_crop")
    return f"""
with s as (select {', '.join(others)}, cast(lv as double) as {column}
           from base_seasons, (select unnest(range({start}, {stop + step}, {step})) as lv)),
x as (select s.region, s.soil_type, s.weather_condition, s.{column}, k.k_crop as crop, {p} as p from s, {_CROPS_SQL} k)
select {', '.join(SEASON)}, {column}, crop, {sql_np_round('p', 4)} as predicted_yield_hg_ha, {R.sql_t('p')} as predicted_yield_t_ha from x"""


@query("sensitivity_curve_rainfall", _curve_sql("rainfall_mm", *D.SWEEP_RAINFALL), ops="R7")
def q_curve_rainfall(c):
    return R.sensitivity_curve(base_seasons(c), _model(c), "rainfall_mm", *D.SWEEP_RAINFALL, keep=SEASON)


@query("sensitivity_curve_temperature", _curve_sql("temperature_celsius", *D.SWEEP_TEMPERATURE), ops="R8")
def q_curve_temperature(c):
    return R.sensitivity_curve(base_seasons(c), _model(c), "temperature_celsius", *D.SWEEP_TEMPERATURE, keep=SEASON)


_BENCH = "case crop " + " ".join(f"when '{k}' then {float(v)}e0" for k, v in D.BENCHMARK_YIELD_HG_HA.items()) + " end"


@query("predict_vs_benchmark", f"""
with x as (select scenario_id, crop, {sql_np_round(_P, 1)} as p1, {_BENCH} as b from valid_scen_crop)
select scenario_id, crop, p1 as predicted_yield_hg_ha, b as fao_benchmark_hg_ha,
  {sql_np_round('(p1 - b) / b * 100.0e0', 1)} as delta_pct, {R.sql_t('p1')} as predicted_yield_t_ha,
  {R.sql_t('b')} as fao_benchmark_t_ha from x""", ops="R9 P18")
def q_predict_vs_benchmark(c):
    return R.predict_vs_benchmark(c.scenarios, _model(c))


@query("pct_vs_benchmark", f"""
select crop, {sql_np_round('(avg(yield_hg_ha) - avg(fao_yield_hg_ha)) / avg(fao_yield_hg_ha) * 100.0e0', 1)} as pct_vs_benchmark
from merged group by crop""", ops="P18")
def q_pct_vs_benchmark(c):
    from harvestry.functions.numeric import np_round
    m, b = F.avg("yield_hg_ha"), F.avg("fao_yield_hg_ha")
    return c.merged.groupBy("crop").agg(np_round((m - b) / b * F.lit(100.0), 1).alias("pct_vs_benchmark"))


def _json_sql() -> str:
    # a double under 0.001 is written as 5.0E-4
    small = "case when water_stress > 0 and water_stress < 0.001 then cast(cast(round(water_stress * 10000) as int) as varchar) || '.0E-4' else cast(water_stress as varchar) end"
    fields = [("rank", "rank"), ("crop", "'\"' || crop || '\"'"), ("predicted_yield_hg_ha", "predicted_yield_hg_ha"),
              ("predicted_yield_t_ha", "predicted_yield_t_ha"), ("water_stress", small), ("heat_stress", "heat_stress"),
              ("fao_benchmark_hg_ha", "fao_benchmark_hg_ha")]
    entry = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields)
    return f"""
select scenario_id, '{{"rankings":[' || string_agg('{{' || {entry} || '}}', ',' order by rank) || ']}}' as response
from ranked_crops group by scenario_id"""


@query("recommend_json", _json_sql(), ops="R11")
def q_recommend_json(c):
    req = c.scenarios.select(F.to_json(F.struct(
        "scenario_id", F.struct(*D.CONDITION_COLUMNS).alias("conditions"))).alias("request"))
    return R.recommend_json(req, _model(c))
