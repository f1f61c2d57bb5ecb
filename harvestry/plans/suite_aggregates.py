"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round, sql_np_round
from harvestry.operators import aggregates as A
from harvestry.plans.registry import query
from harvestry.sources import fixtures as FX


@query("group_mean", f"""
select country, year, {sql_np_round('avg(avg_temp)', 2)} as avg_temp from ref_temp group by country, year""",
       ops="A1")
def q_group_mean(c):
    return A.group_mean(c.ref_temp, ["country", "year"], "avg_temp", 2)


@query("group_median", "select crop, median(yield_hg_ha) as median from merged group by crop", ops="A2")
def q_group_median(c):
    return A.group_median(c.merged, ["crop"], "yield_hg_ha")


_A3 = ["yield_hg_ha", "fao_yield_hg_ha"]


@query("group_count_mean", "select crop, " + ", ".join(
    f"count({v}) as {v}_count, {sql_np_round(f'avg({v})', 0)} as {v}_mean" for v in _A3)
       + " from merged group by crop", ops="A3 J9")
def q_group_count_mean(c):
    return A.group_count_mean(c.merged, ["crop"], _A3, 0)


@query("yearly_trend", f"""
select year, {sql_np_round('avg(fao_yield_hg_ha)', 4)} as mean, median(fao_yield_hg_ha) as median
from ref_yield group by year""", ops="A4")
def q_yearly_trend(c):
    t = A.yearly_trend(c.ref_yield, "year", "fao_yield_hg_ha")
    return t.select("year", np_round("mean", 4).alias("mean"), "median")


_FAO = ["fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp"]


@query("group_first", "select crop, " + ", ".join(f"min({v}) as {v}" for v in _FAO) + " from merged group by crop",
       ops="A5")
def q_group_first(c):
    return A.group_first(c.merged, ["crop"], _FAO)


@query("value_counts", "select soil_type, count(*) as n from farm_obs group by soil_type", ops="A6")
def q_value_counts(c):
    return A.value_counts(c.farm_obs, "soil_type")


_A7 = ["crop", "region", "soil_type", "weather_condition", "year", "days_to_harvest", "rainfall_mm"]


@query("distinct_counts", "select " + ", ".join(f"count(distinct {v}) as {v}_nunique" for v in _A7) + " from merged",
       ops="A7")
def q_distinct_counts(c):
    return A.distinct_counts(c.merged, _A7)


@query("distinct_values", "select distinct crop from farm_obs where crop is not null", ops="A8")
def q_distinct_values(c):
    return A.distinct_values(c.farm_obs, "crop")


_A9 = ["yield_hg_ha", "rainfall_mm", "temperature_celsius", "days_to_harvest"]


@query("value_range", "select " + ", ".join(f"min({v}) as {v}_min, max({v}) as {v}_max" for v in _A9) + " from merged",
       ops="A9")
def q_value_range(c):
    return A.value_range(c.merged, _A9)


@query("pivot_mean", "select crop, " + ", ".join(
    f"{sql_np_round(f'avg(case when region = {chr(39)}{r}{chr(39)} then yield_hg_ha end)', 4)} as {r}"
    for r in D.REGIONS) + " from merged group by crop", ops="A10")
def q_pivot_mean(c):
    return A.pivot_mean(c.merged, "crop", "region", D.REGIONS, "yield_hg_ha")


_NUM = ["rainfall_mm", "temperature_celsius", "days_to_harvest", "yield_hg_ha", "fao_yield_hg_ha",
        "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp", "year"]


def _describe_sql(cols):
    parts = []
    for v in cols:
        parts.append(f"""select '{v}' as "column", count({v}) as count, {sql_np_round(f'avg({v})', 6)} as mean,
  {sql_np_round(f'stddev_samp({v})', 6)} as std, min(cast({v} as double)) as min,
  {sql_np_round(f'quantile_cont({v}, 0.25)', 6)} as p25, {sql_np_round(f'quantile_cont({v}, 0.5)', 6)} as p50,
  {sql_np_round(f'quantile_cont({v}, 0.75)', 6)} as p75, max(cast({v} as double)) as max from merged""")
    return "\nunion all ".join(parts)


@query("describe_numeric", _describe_sql(_NUM), ops="A11")
def q_describe_numeric(c):
    return A.describe_numeric(c.merged, _NUM)


_CAT = ["crop", "region", "soil_type", "weather_condition"]


def _describe_cat_sql(cols):
    parts = []
    for v in cols:
        parts.append(f"""select '{v}' as "column", cast(sum(freq) as bigint) as count, count(*) as "unique",
  arg_min(value, struct_pack(nf := -freq, v := value)) as top, max(freq) as freq
from (select {v} as value, count(*) as freq from merged where {v} is not null group by {v})""")
    return "\nunion all ".join(parts)


@query("describe_categorical", _describe_cat_sql(_CAT), ops="A12")
def q_describe_categorical(c):
    return A.describe_categorical(c.merged, _CAT)


@query("practice_impact", f"""
select {sql_np_round('avg(case when fertilizer_used then yield_hg_ha end)', 4)} as mean_with,
  {sql_np_round('avg(case when not fertilizer_used then yield_hg_ha end)', 4)} as mean_without,
  {sql_np_round('avg(case when fertilizer_used then yield_hg_ha end) - avg(case when not fertilizer_used then yield_hg_ha end)', 4)} as lift
from merged""", ops="A13")
def q_practice_impact(c):
    return A.practice_impact(c.merged, "fertilizer_used", "yield_hg_ha")


@query("country_crop_means", f"""
select fao_crop, {sql_np_round('avg(fao_yield_hg_ha)', 0)} as mean_yield from ref_yield
where country = '{FX.COUNTRY_LONG}' and year between {FX.YEAR_START} and {FX.YEAR_END} group by fao_crop""", ops="A14")
def q_country_crop_means(c):
    f = c.ref_yield.where((F.col("country") == FX.COUNTRY_LONG) & F.col("year").between(FX.YEAR_START, FX.YEAR_END))
    return A.group_mean(f, ["fao_crop"], "fao_yield_hg_ha", 0, "mean_yield").orderBy(F.desc("mean_yield"))


def _feature_summary_sql(cols, dtypes):
    parts = []
    for v in cols:
        parts.append(f"""select '{v}' as "column", '{dtypes[v]}' as dtype, count(distinct cast({v} as double)) as "unique",
  min(cast({v} as double)) as min, {sql_np_round(f'avg({v})', 6)} as mean, max(cast({v} as double)) as max,
  {sql_np_round(f'stddev_samp({v})', 6)} as std from features""")
    return "\nunion all ".join(parts)


_FDTYPES = {f: ("int" if f in D.INT_FEATURES else "double") for f in D.FEATURES}


@query("feature_summary", _feature_summary_sql(D.FEATURES, _FDTYPES), ops="A15")
def q_feature_summary(c):
    return A.feature_summary(c.features, D.FEATURES)


@query("constant_columns", "\nunion all ".join(
    f"""select '{v}' as "column", min(cast({v} as double)) = max(cast({v} as double)) as is_constant from merged"""
    for v in _NUM), ops="A16")
def q_constant_columns(c):
    return A.constant_columns(c.merged, _NUM)
