"""Queries: projections, filters and cleaning."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round, sql_np_round
from harvestry.operators import cleaning as P
from harvestry.operators.joins import clean_observations, filter_country_years
from harvestry.plans.registry import query
from harvestry.sources import fixtures as FX

# --- fixed values: raw header spellings of the observation file --------------
RAW_OBS_HEADERS = {
    "region": "Region", "soil_type": "Soil_Type", "crop": "Crop", "rainfall_mm": "Rainfall_mm",
    "temperature_celsius": "Temperature_Celsius", "fertilizer_used": "Fertilizer_Used",
    "irrigation_used": "Irrigation_Used", "weather_condition": "Weather_Condition",
    "days_to_harvest": "Days_to_Harvest", "yield_tons_per_hectare": "Yield_tons_per_hectare",
}
OBS_COLS = list(RAW_OBS_HEADERS)


@query("normalize_columns", "select " + ", ".join(OBS_COLS) + " from farm_obs", ops="P1")
def q_normalize_columns(c):
    raw = c.farm_obs.select(*[F.col(k).alias(f" {v} " if k == "crop" else v) for k, v in RAW_OBS_HEADERS.items()])
    return P.normalize_columns(raw)


@query("rename_select", "select country, fao_crop as crop, year, fao_yield_hg_ha as yield_hg_ha from ref_yield",
       ops="P2")
def q_rename_select(c):
    return P.rename_select(c.ref_yield, {"fao_crop": "crop", "fao_yield_hg_ha": "yield_hg_ha"},
                           ["country", "crop", "year", "yield_hg_ha"])


_FLAG_TEXT = {0: "True", 1: "False", 2: "true", 3: "yes"}


def _flag_text(col):
    from harvestry.functions.numeric import case_map
    return case_map(col, _FLAG_TEXT)


@query("parse_boolean", """
with t as (select case l_orderkey % 5 when 0 then 'True' when 1 then 'False' when 2 then 'true' when 3 then 'yes' end as flag_text
           from farm_obs)
select flag_text, case when flag_text = 'True' then true when flag_text = 'False' then false end as parsed,
  count(*) as n from t group by 1, 2""", ops="P3")
def q_parse_boolean(c):
    t = c.farm_obs.select(_flag_text(F.col("l_orderkey") % 5).alias("flag_text"))
    return t.groupBy("flag_text", P.parse_boolean("flag_text").alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_numeric", """
with t as (select case l_linenumber % 5 when 0 then cast(rainfall_mm as varchar) when 1 then ' 12 '
             when 2 then '..' when 3 then 'abc' else '' end as value_text from farm_obs)
select value_text, try_cast(value_text as double) as value from t""", ops="P4")
def q_coerce_numeric(c):
    from harvestry.functions.numeric import case_map
    txt = F.when(F.col("l_linenumber") % 5 == 0, F.col("rainfall_mm").cast("string")).otherwise(
        case_map(F.col("l_linenumber") % 5, {1: " 12 ", 2: "..", 3: "abc"}, ""))
    return c.farm_obs.select(txt.alias("value_text")).select("value_text", P.coerce_numeric("value_text").alias("value"))


@query("drop_null_target", "select * from ref_rain where fao_rainfall_mm is not null", ops="P5")
def q_drop_null_target(c):
    return P.drop_null_target(c.ref_rain, ["fao_rainfall_mm"])


_KEEP_AFTER_DROP = [x for x in D.MERGED_COLUMNS if x not in ("year", "fao_pesticides_tonnes")]


@query("drop_columns", "select " + ", ".join(_KEEP_AFTER_DROP) + " from merged", ops="P6 A16")
def q_drop_columns(c):
    return P.drop_columns(c.merged, ["year", "fao_pesticides_tonnes", "not_a_column"])


@query("clean_observations", "select * from obs_clean", ops="P7")
def q_clean_observations(c):
    return clean_observations(c.farm_obs)


@query("filter_country_years", f"""
select * from ref_yield where country = '{FX.COUNTRY_LONG}' and year between {FX.YEAR_START} and {FX.YEAR_END}""",
       ops="P8")
def q_filter_country_years(c):
    return filter_country_years(c.ref_yield, FX.COUNTRY_LONG, FX.YEAR_START, FX.YEAR_END)


@query("filter_semi", "select * from farm_obs where crop in (select crop from lookup_ref)", ops="P9 J4")
def q_filter_semi(c):
    return c.farm_obs.join(c.lookup_ref_year.select("crop"), "crop", "left_semi")


@query("map_values", """
select country, fao_crop, year, coalesce(case fao_crop when 'Maize' then 'Maize' when 'Rice, paddy' then 'Rice'
  when 'Soybeans' then 'Soybean' when 'Wheat' then 'Wheat' end, 'Other') as crop from ref_yield""", ops="P10 J3")
def q_map_values(c):
    return P.map_values(c.ref_yield.select("country", "fao_crop", "year"), "fao_crop", D.FAO_TO_CROP,
                        out="crop", default="Other")


@query("map_values_table", """
select o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, o.crop,
  coalesce(b.opt_rain, -1.0e0) as opt_rain from farm_obs o left join benchmarks b on o.crop = b.crop""",
       ops="P10 J3")
def q_map_values_table(c):
    bench = FX.benchmarks_df(c.spark).select(F.col("crop").alias("key"), F.col("opt_rain").alias("value"))
    return P.map_values(c.farm_obs.select(*FX.OBS_KEY, "crop"), "crop", bench, out="opt_rain", default=-1.0)


_ROUND = {"rainfall_mm": 1, "temperature_celsius": 0, "yield_hg_ha": -2}


@query("round_columns", "select crop, " + ", ".join(
    f"{sql_np_round(k, n) if n >= 0 else f'(round_even({k} / 1e{-n}, 0) * 1e{-n})'} as {k}" for k, n in _ROUND.items())
       + " from merged", ops="P11")
def q_round_columns(c):
    pos = {k: n for k, n in _ROUND.items() if n >= 0}
    df = P.round_columns(c.merged.select("crop", *_ROUND), pos)
    return df.withColumn("yield_hg_ha", F.rint(F.col("yield_hg_ha") / F.lit(100.0)) * F.lit(100.0))


@query("convert_units", f"""
select crop, yield_hg_ha, {sql_np_round('yield_hg_ha / 10000.0e0', 4)} as yield_t_ha,
  {sql_np_round(sql_np_round('yield_hg_ha / 10000.0e0', 4) + ' * 10000.0e0', 2)} as yield_hg_ha_back from merged""",
       ops="P12")
def q_convert_units(c):
    t = np_round(P.convert_units("yield_hg_ha", 10000.0, divide=True), 4)
    return c.merged.select("crop", "yield_hg_ha", t.alias("yield_t_ha"),
                           np_round(P.convert_units(t, 10000.0), 2).alias("yield_hg_ha_back"))


_ORDER = ["yield_hg_ha", "crop", "year", "region"]


@query("project_order", "select " + ", ".join(_ORDER) + " from merged", ops="P13")
def q_project_order(c):
    return c.merged.select(*_ORDER)


@query("search_names", """
select distinct country, coalesce(lower(country) like '%nation_1%', false) as matches from ref_yield""", ops="P14")
def q_search_names(c):
    return c.ref_yield.select("country", P.search_names("country", "NATION_1").alias("matches")).distinct()


@query("bool_to_int", "select crop, cast(fertilizer_used as int) as fertilizer_used, "
       "cast(irrigation_used as int) as irrigation_used from merged", ops="P15")
def q_bool_to_int(c):
    return P.bool_to_int(c.merged.select("crop", "fertilizer_used", "irrigation_used"),
                         ["fertilizer_used", "irrigation_used"])


@query("log_target", f"select crop, yield_hg_ha, {sql_np_round('ln(1 + yield_hg_ha)', 9)} as log_yield from merged "
       "where yield_hg_ha > -1", ops="P16")
def q_log_target(c):
    return (c.merged.where(F.col("yield_hg_ha") > -1)
            .select("crop", "yield_hg_ha", np_round(P.log_target("yield_hg_ha"), 9).alias("log_yield")))


_NUMERIC_MERGED = ["year", "rainfall_mm", "temperature_celsius", "days_to_harvest", "yield_hg_ha",
                   "fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp"]


@query("select_numeric", "select " + ", ".join(_NUMERIC_MERGED) + " from merged", ops="P20")
def q_select_numeric(c):
    return c.merged.select(*P.numeric_columns(c.merged))


@query("clip_lower", """
select country, year, fao_rainfall_mm,
  case when fao_rainfall_mm is null then null else greatest(fao_rainfall_mm - 30.0e0, 0.0e0) end as clipped
from ref_rain""", ops="P21")
def q_clip_lower(c):
    return c.ref_rain.select("country", "year", "fao_rainfall_mm",
                             P.clip_lower(F.col("fao_rainfall_mm") - F.lit(30.0), 0.0).alias("clipped"))


@query("assemble_features", "select [" + ", ".join(f"cast({f} as double)" for f in D.FEATURES)
       + f"] as features, {D.TARGET} as label from features", ops="P19")
def q_assemble_features(c):
    va = VectorAssembler(inputCols=D.FEATURES, outputCol="features", handleInvalid="error")
    return va.transform(c.features).select(vector_to_array("features").alias("features"), F.col(D.TARGET).alias("label"))
