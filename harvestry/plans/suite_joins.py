"""Queries for joins (J1–J9) and the derived views every other suite uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.features import merged_feature_sql
from harvestry.functions.numeric import sql_case_map, sql_np_round
from harvestry.operators import joins as J
from harvestry.plans.registry import query, view
from harvestry.sources import fixtures as FX

for _name, _sql in FX.SQL_VIEWS.items():
    view(_name, _sql)


def sql_lookup(year_start: int, year_end: int, tag: str) -> str:
    """J8 in SQL; the nested CTE names carry ``tag`` so two lookups can coexist."""
    rng = f"year between {year_start} and {year_end}"
    items = ", ".join(f"'{k}'" for k in D.FAO_TO_CROP)
    return f"""
with {tag}_y as (select fao_crop, year, try_cast(fao_yield_hg_ha as double) as fao_yield_hg_ha
           from ref_yield where country = '{FX.COUNTRY_LONG}' and {rng}),
  {tag}_p as (select year, try_cast(fao_pesticides_tonnes as double) as fao_pesticides_tonnes
           from ref_pest where country = '{FX.COUNTRY_LONG}' and {rng}),
  {tag}_r0 as (select year, try_cast(fao_rainfall_mm as double) as fao_rainfall_mm
           from ref_rain where country = '{FX.COUNTRY_SHORT}' and {rng}),
  {tag}_r as (select year, coalesce(fao_rainfall_mm, (select median(fao_rainfall_mm) from {tag}_r0)) as fao_rainfall_mm
           from {tag}_r0),
  {tag}_t0 as (select year, {sql_np_round('avg(try_cast(avg_temp as double))', 2)} as fao_avg_temp
           from ref_temp where country = '{FX.COUNTRY_SHORT}' and {rng} group by year),
  {tag}_t as (select year, coalesce(fao_avg_temp, (select median(fao_avg_temp) from {tag}_t0)) as fao_avg_temp
           from {tag}_t0),
  {tag}_m as (select y.fao_crop, y.year, y.fao_yield_hg_ha, p.fao_pesticides_tonnes, r.fao_rainfall_mm, t.fao_avg_temp
           from {tag}_y y left join {tag}_p p on y.year = p.year left join {tag}_r r on y.year = r.year
           left join {tag}_t t on y.year = t.year),
  {tag}_m2 as (select fao_crop, year, fao_yield_hg_ha, fao_pesticides_tonnes, fao_avg_temp,
           coalesce(fao_rainfall_mm, (select median(fao_rainfall_mm) from {tag}_m)) as fao_rainfall_mm from {tag}_m)
select {sql_case_map('fao_crop', D.FAO_TO_CROP)} as crop, cast(year as int) as year,
  {sql_np_round('fao_yield_hg_ha', 2)} as fao_yield_hg_ha,
  {sql_np_round('fao_rainfall_mm', 2)} as fao_rainfall_mm,
  {sql_np_round('fao_pesticides_tonnes', 2)} as fao_pesticides_tonnes,
  {sql_np_round('fao_avg_temp', 2)} as fao_avg_temp
from {tag}_m2 where fao_crop in ({items})"""


view("lookup_ref", sql_lookup(FX.REFERENCE_YEAR, FX.REFERENCE_YEAR, "lr"))
view("lookup_range", sql_lookup(FX.YEAR_START, FX.YEAR_END, "lg"))
view("obs_clean", "select * from farm_obs where not coalesce(yield_tons_per_hectare < 0, false)")
view("merged", "select " + ", ".join(
    f"{sql_np_round('o.yield_tons_per_hectare * 10000.0e0', 2)} as yield_hg_ha" if c == "yield_hg_ha"
    else (f"k.{c}" if c in ("year", "fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp")
          else f"o.{c}")
    for c in D.MERGED_COLUMNS) + " from obs_clean o join lookup_ref k on o.crop = k.crop")
view("merged_keyed", "select " + ", ".join(f"o.{k}" for k in FX.OBS_KEY) + ", " + ", ".join(
    f"{sql_np_round('o.yield_tons_per_hectare * 10000.0e0', 2)} as yield_hg_ha" if c == "yield_hg_ha"
    else (f"k.{c}" if c in ("year", "fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp")
          else f"o.{c}")
    for c in D.MERGED_COLUMNS) + " from obs_clean o join lookup_ref k on o.crop = k.crop")
_FSQL = merged_feature_sql()
view("features", "select " + ", ".join(f"{_FSQL[f]} as {f}" for f in D.FEATURES)
     + ", yield_hg_ha from merged")


@query("build_reference_lookup", "select * from lookup_range", ops="J8 P8 A1 J2 Q3 Q4 P9 P10 P11 P13")
def q_build_reference_lookup(c):
    return c.lookup(FX.YEAR_START, FX.YEAR_END)


@query("merge_datasets", "select * from merged", ops="J9 S2 P7 J1 P12 P13")
def q_merge_datasets(c):
    return c.merged


@query("join_inner_lookup",
       "select o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, o.crop, k.fao_yield_hg_ha "
       "from farm_obs o join lookup_ref k on o.crop = k.crop", ops="J1")
def q_join_inner_lookup(c):
    lk = c.lookup_ref_year.select("crop", "fao_yield_hg_ha")
    return c.farm_obs.select(*FX.OBS_KEY, "crop").join(lk, "crop", "inner")


@query("join_left_chain", f"""
select y.country, y.fao_crop, y.year, y.fao_yield_hg_ha, p.fao_pesticides_tonnes, r.fao_rainfall_mm
from (select * from ref_yield where country = '{FX.COUNTRY_LONG}') y
left join (select year, fao_pesticides_tonnes from ref_pest where country = '{FX.COUNTRY_LONG}') p on y.year = p.year
left join (select year, fao_rainfall_mm from ref_rain where country = '{FX.COUNTRY_SHORT}') r on y.year = r.year""",
       ops="J2")
def q_join_left_chain(c):
    y = c.ref_yield.where(F.col("country") == FX.COUNTRY_LONG)
    p = c.ref_pest.where(F.col("country") == FX.COUNTRY_LONG).select("year", "fao_pesticides_tonnes")
    r = c.ref_rain.where(F.col("country") == FX.COUNTRY_SHORT).select("year", "fao_rainfall_mm")
    # one country: at most one row per year on each right side; AQE sizes them
    return J.join_left_chain(y, [p, r], "year").select(
        "country", "fao_crop", "year", "fao_yield_hg_ha", "fao_pesticides_tonnes", "fao_rainfall_mm")


@query("cross_crops", "select s.scenario_id, c.crop from scenarios s, "
       "(select unnest(['Maize','Rice','Soybean','Wheat']) as crop) c", ops="J5")
def q_cross_crops(c):
    return J.cross_crops(c.scenarios.select("scenario_id"))


@query("cross_grid", """
select s.scenario_id, s.rainfall_mm, g.fertilizer_used, g.irrigation_used, g.days_to_harvest
from scenarios s, (select f as fertilizer_used, i as irrigation_used, d as days_to_harvest
  from (select unnest([true, false]) as f), (select unnest([true, false]) as i),
       (select cast(unnest(range(60, 210, 10)) as int) as d)) g""", ops="J6")
def q_cross_grid(c):
    return J.cross_grid(c.scenarios.select("scenario_id", "rainfall_mm", "fertilizer_used",
                                           "irrigation_used", "days_to_harvest")).drop("grid_pos")


@query("compare_sources", f"""
with a as (select crop, avg(yield_hg_ha) as m from merged group by crop),
b as (select crop, avg(fao_yield_hg_ha) as m from lookup_range group by crop)
select a.crop, {sql_np_round('a.m', 4)} as obs_mean_hg_ha, {sql_np_round('b.m', 4)} as ref_mean_hg_ha,
  {sql_np_round('a.m / 10000.0e0', 6)} as obs_mean_t_ha, {sql_np_round('b.m / 10000.0e0', 6)} as ref_mean_t_ha
from a join b on a.crop = b.crop""", ops="J7 P12")
def q_compare_sources(c):
    from harvestry.functions.numeric import np_round
    a = c.merged.groupBy("crop").agg(F.avg("yield_hg_ha").alias("m_obs"))
    b = c.lookup(FX.YEAR_START, FX.YEAR_END).groupBy("crop").agg(F.avg("fao_yield_hg_ha").alias("m_ref"))
    return a.join(b, "crop").select(
        "crop", np_round("m_obs", 4).alias("obs_mean_hg_ha"), np_round("m_ref", 4).alias("ref_mean_hg_ha"),
        np_round(F.col("m_obs") / 10000.0, 6).alias("obs_mean_t_ha"),
        np_round(F.col("m_ref") / 10000.0, 6).alias("ref_mean_t_ha"))
