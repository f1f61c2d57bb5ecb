"""Queries: data quality (Q1–Q14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import sql_np_round
from harvestry.operators import quality as Q
from harvestry.operators.joins import impute_with_median
from harvestry.operators.validation import sql_condition_reasons, validate
from harvestry.plans.registry import query, view
from harvestry.sources import fixtures as FX

# --- fixed values: boundary and rejected farm records of the request tests ---
# (id, crop, rain, temp, days, region, soil, weather, fert, irri)
EDGE_REQUESTS = [
    ("E01", "Maize", 0.0, -10.0, 1, "East", "Loam", "Sunny", True, True),
    ("E02", "Rice", 5000.0, 50.0, 365, "West", "Clay", "Rainy", True, True),
    ("E03", "Maize", -1.0, 22.0, 120, "East", "Loam", "Sunny", True, True),
    ("E04", "Maize", 5001.0, 22.0, 120, "East", "Loam", "Sunny", True, True),
    ("E05", "Maize", 650.0, -11.0, 120, "East", "Loam", "Sunny", True, True),
    ("E06", "Maize", 650.0, 51.0, 120, "East", "Loam", "Sunny", True, True),
    ("E07", "Maize", 650.0, 22.0, 0, "East", "Loam", "Sunny", True, True),
    ("E08", "Maize", 650.0, 22.0, 366, "East", "Loam", "Sunny", True, True),
    ("E09", "Maize", 650.0, 22.0, 120, "Central", "Loam", "Sunny", True, True),
    ("E10", "Maize", 650.0, 22.0, 120, "East", "Gravel", "Sunny", True, True),
    ("E11", "Maize", 650.0, 22.0, 120, "East", "Loam", "Windy", True, True),
    ("E12", "Barley", 650.0, 22.0, 120, "East", "Loam", "Sunny", True, True),
    ("E13", None, 650.0, 22.0, 120, "East", "Loam", "Sunny", None, None),
    ("E14", "Wheat", 650.0, -15.0, 120, "East", "Loam", "Sunny", True, True),
    ("E15", "Wheat", 650.0, 55.0, 120, "East", "Loam", "Sunny", True, True),
]
_REQ_SCHEMA = ("scenario_id string, crop string, rainfall_mm double, temperature_celsius double, "
               "days_to_harvest int, region string, soil_type string, weather_condition string, "
               "fertilizer_used boolean, irrigation_used boolean")


def _sql_lit(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, float):
        return f"cast({v!r} as double)"
    return f"cast({v} as int)"


view("edge_requests", "select * from (values " + ", ".join(
    "(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in EDGE_REQUESTS)
     + ") as v(" + ", ".join(FX.SCENARIO_COLUMNS) + ")")
view("requests", "select * from scenarios union all select * from edge_requests")


def requests(c):
    edge = c.spark.createDataFrame(EDGE_REQUESTS, _REQ_SCHEMA)
    return c.scenarios.unionByName(edge)


# joined reference table with gaps: every yield row with its country's rainfall
view("ref_joined", """
select y.country, y.fao_crop, y.year, y.fao_yield_hg_ha, r.fao_rainfall_mm
from ref_yield y left join ref_rain r on replace(y.country, 'NATION_', 'N') = r.country and y.year = r.year""")


def ref_joined(c):
    r = c.ref_rain.withColumnRenamed("country", "short")
    y = c.ref_yield.withColumn("short", F.replace(F.col("country"), F.lit("NATION_"), F.lit("N")))
    return y.join(r, ["short", "year"], "left").select("country", "fao_crop", "year", "fao_yield_hg_ha",
                                                       "fao_rainfall_mm")


_RJ = ["country", "fao_crop", "year", "fao_yield_hg_ha", "fao_rainfall_mm"]


@query("null_audit", "with t as (select count(*) as n, " + ", ".join(
    f"count(*) - count({c}) as {c}" for c in _RJ) + " from ref_joined)\n" + "\nunion all ".join(
    f"select '{c}' as \"column\", cast({c} as bigint) as n_null, {sql_np_round(f'{c} / n * 100.0e0', 4)} as pct_null "
    f"from t where {c} > 0" for c in _RJ), ops="Q1")
def q_null_audit(c):
    return Q.null_audit(ref_joined(c))


@query("null_total", "select cast(" + " + ".join(f"(count(*) - count({c}))" for c in _RJ)
       + " as bigint) as total_nulls from ref_joined", ops="Q2")
def q_null_total(c):
    return Q.null_total(ref_joined(c))


@query("impute_median", f"""
with r as (select year, fao_rainfall_mm from ref_rain where country = '{FX.COUNTRY_SHORT}')
select year, coalesce(fao_rainfall_mm, (select median(fao_rainfall_mm) from r)) as fao_rainfall_mm from r""",
       ops="Q3")
def q_impute_median(c):
    r = c.ref_rain.where(F.col("country") == FX.COUNTRY_SHORT).select("year", "fao_rainfall_mm")
    return impute_with_median(r, "fao_rainfall_mm")


@query("impute_after_join", f"""
with m as (select y.fao_crop, y.year, r.fao_rainfall_mm from ref_yield y
           left join (select year, fao_rainfall_mm from ref_rain where country = '{FX.COUNTRY_SHORT}') r on y.year = r.year
           where y.country = '{FX.COUNTRY_LONG}')
select fao_crop, year, coalesce(fao_rainfall_mm, (select median(fao_rainfall_mm) from m)) as fao_rainfall_mm from m""",
       ops="Q4")
def q_impute_after_join(c):
    y = c.ref_yield.where(F.col("country") == FX.COUNTRY_LONG).select("fao_crop", "year")
    r = c.ref_rain.where(F.col("country") == FX.COUNTRY_SHORT).select("year", "fao_rainfall_mm")
    m = y.join(r, "year", "left").select("fao_crop", "year", "fao_rainfall_mm")
    return impute_with_median(m, "fao_rainfall_mm")


@query("impute_group_median", """
select r.country, r.year, coalesce(r.fao_rainfall_mm, m.med) as fao_rainfall_mm
from ref_rain r left join (select country, median(fao_rainfall_mm) as med from ref_rain group by country) m
  on r.country = m.country""", ops="Q5")
def q_impute_group_median(c):
    return Q.impute_group_median(c.ref_rain, ["country"], "fao_rainfall_mm")


@query("duplicate_count", f"""
with g as (select count(*) as c from merged group by {', '.join(D.MERGED_COLUMNS)})
select cast(sum(c) as bigint) as n_rows, cast(sum(c - 1) as bigint) as n_duplicates,
  {sql_np_round('sum(c - 1) / sum(c) * 100.0e0', 4)} as pct_duplicates from g""", ops="Q6")
def q_duplicate_count(c):
    return Q.duplicate_count(c.merged)


@query("drop_duplicates", "select distinct * from merged", ops="Q7")
def q_drop_duplicates(c):
    return Q.drop_duplicates(c.merged)


view("ref_sparse", """
select y.country, y.fao_crop, y.year, y.fao_yield_hg_ha, r.fao_rainfall_mm
from ref_yield y left join (select * from ref_rain where year = 2000) r
  on replace(y.country, 'NATION_', 'N') = r.country and y.year = r.year""")


@query("drop_sparse_columns", "select country, fao_crop, year, fao_yield_hg_ha from ref_sparse", ops="Q8")
def q_drop_sparse_columns(c):
    r = c.ref_rain.where(F.col("year") == 2000).withColumnRenamed("country", "short")
    y = c.ref_yield.withColumn("short", F.replace(F.col("country"), F.lit("NATION_"), F.lit("N")))
    t = y.join(r, ["short", "year"], "left").select("country", "fao_crop", "year", "fao_yield_hg_ha", "fao_rainfall_mm")
    return Q.drop_sparse_columns(t, 0.8)


_RJ_TYPES = {"country": "string", "fao_crop": "string", "year": "int", "fao_yield_hg_ha": "double",
             "fao_rainfall_mm": "double"}


@query("schema_profile", "\nunion all ".join(
    f"""select '{c}' as "column", '{_RJ_TYPES[c]}' as dtype, cast(count(*) - count({c}) as bigint) as n_null,
  {sql_np_round(f'(count(*) - count({c})) / count(*) * 100.0e0', 4)} as pct_null,
  cast(count(distinct {c}) as bigint) as n_distinct, cast(min({c}) as varchar) as sample from ref_joined"""
    for c in _RJ), ops="Q9")
def q_schema_profile(c):
    return Q.schema_profile(ref_joined(c))


@query("validate_conditions", f"""
select scenario_id, {sql_condition_reasons()} as reasons, {sql_condition_reasons()} = '' as is_valid,
  coalesce(fertilizer_used, true) as fertilizer_used, coalesce(irrigation_used, true) as irrigation_used
from requests""", ops="Q10")
def q_validate_conditions(c):
    v = validate(requests(c))
    return v.select("scenario_id", F.concat_ws("; ", "reasons").alias("reasons"), "is_valid",
                    "fertilizer_used", "irrigation_used")


@query("validate_crop", f"""
select scenario_id, crop, {sql_condition_reasons(check_crop=True)} as reasons,
  {sql_condition_reasons(check_crop=True)} = '' as is_valid from requests""", ops="Q11")
def q_validate_crop(c):
    v = validate(requests(c), check_crop=True)
    return v.select("scenario_id", "crop", F.concat_ws("; ", "reasons").alias("reasons"), "is_valid")


@query("name_mismatch_report", """
with a as (select distinct country from ref_yield), b as (select distinct country from ref_pest),
 r as (select distinct country from ref_rain), t as (select distinct country from ref_temp),
 k as (select country from a union select country from b union select country from r union select country from t)
select k.country, a.country is not null as in_yield, b.country is not null as in_pest,
  r.country is not null as in_rain, t.country is not null as in_temp
from k left join a on k.country = a.country left join b on k.country = b.country
  left join r on k.country = r.country left join t on k.country = t.country""", ops="Q12")
def q_name_mismatch_report(c):
    return Q.name_mismatch_report({"yield": c.ref_yield, "pest": c.ref_pest, "rain": c.ref_rain,
                                   "temp": c.ref_temp}, "country")


@query("row_loss_report", f"""
with s as (select count(*) as n_raw,
   count(case when not coalesce(yield_tons_per_hectare < 0, false) then 1 end) as n_clean,
   count(case when not coalesce(yield_tons_per_hectare < 0, false) and crop in (select crop from lookup_ref) then 1 end) as n_crop
 from farm_obs)
select 'drop_negative_target' as step, n_raw as n_before, n_clean as n_after, n_raw - n_clean as n_removed,
  {sql_np_round('(n_raw - n_clean) / n_raw * 100.0e0', 4)} as pct_removed from s
union all select 'keep_reference_crops', n_clean, n_crop, n_clean - n_crop,
  {sql_np_round('(n_clean - n_crop) / n_clean * 100.0e0', 4)} from s""", ops="Q13")
def q_row_loss_report(c):
    from harvestry.functions.numeric import np_round
    crops = c.lookup_ref_year.select("crop", F.lit(True).alias("__has"))
    o = c.farm_obs.join(crops, "crop", "left")
    keep = ~F.coalesce(F.col("yield_tons_per_hectare") < 0, F.lit(False))
    s = o.agg(F.count(F.lit(1)).alias("n_raw"), F.count(F.when(keep, 1)).alias("n_clean"),
              F.count(F.when(keep & F.col("__has").isNotNull(), 1)).alias("n_crop"))
    steps = F.array(
        F.struct(F.lit("drop_negative_target").alias("step"), F.col("n_raw").alias("n_before"),
                 F.col("n_clean").alias("n_after")),
        F.struct(F.lit("keep_reference_crops").alias("step"), F.col("n_clean").alias("n_before"),
                 F.col("n_crop").alias("n_after")))
    return s.select(F.inline(steps)).select(
        "step", "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"),
        np_round((F.col("n_before") - F.col("n_after")) / F.col("n_before") * F.lit(100.0), 4).alias("pct_removed"))


@query("negative_report", f"""
select count(*) as n_rows, count(case when yield_tons_per_hectare < 0 then 1 end) as n_negative,
  {sql_np_round('count(case when yield_tons_per_hectare < 0 then 1 end) / count(*) * 100.0e0', 6)} as pct_negative,
  min(case when yield_tons_per_hectare < 0 then yield_tons_per_hectare end) as min_negative,
  max(case when yield_tons_per_hectare < 0 then yield_tons_per_hectare end) as max_negative,
  {sql_np_round('avg(case when yield_tons_per_hectare < 0 then yield_tons_per_hectare end)', 6)} as mean_negative
from farm_obs""", ops="Q14")
def q_negative_report(c):
    return Q.negative_report(c.farm_obs, "yield_tons_per_hectare")

