"""Queries: sources and sinks.

Each loader query first exports its fixture view as a raw CSV file (with
the raw header spellings) under the shared checkpoint folder, then runs the
loader on it, so the whole read path is exercised on data that grows with
the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import np_round, sql_np_round
from harvestry.operators.aggregates import group_first
from harvestry.plans.registry import query, view
from harvestry.plans.suite_cleaning import RAW_OBS_HEADERS
from harvestry.session import shared_path
from harvestry.sources import loaders as L


def _flags_as_text(df):
    return df.withColumns({c: F.when(F.col(c), F.lit("True")).otherwise(F.lit("False"))
                           for c in ("fertilizer_used", "irrigation_used")})


def export_observations(c):
    obs = _flags_as_text(c.farm_obs.select(*RAW_OBS_HEADERS))
    return L.write_csv(obs, shared_path(c.spark, "raw_observations"), RAW_OBS_HEADERS)


def export_ref_yield(c):
    return L.write_csv(c.ref_yield, shared_path(c.spark, "raw_yield"),
                       {"country": "Area", "fao_crop": "Item", "year": "Year", "fao_yield_hg_ha": "Value"})


def export_ref_pest(c):
    return L.write_csv(c.ref_pest, shared_path(c.spark, "raw_pesticides"),
                       {"country": "Area", "year": "Year", "fao_pesticides_tonnes": "Value"})


def export_ref_rain(c):
    return L.write_csv(c.ref_rain, shared_path(c.spark, "raw_rainfall"),
                       {"country": " Area", "year": "Year", "fao_rainfall_mm": "average_rain_fall_mm_per_year"})


def export_ref_temp(c):
    return L.write_csv(c.ref_temp.select("year", "country", "avg_temp"), shared_path(c.spark, "raw_temp"))


def premerged(c):
    y = c.ref_yield.withColumn("short", F.replace(F.col("country"), F.lit("NATION_"), F.lit("N")))
    p = c.ref_pest
    r = c.ref_rain.withColumnRenamed("country", "short")
    t = c.ref_temp.groupBy(F.col("country").alias("short"), "year").agg(np_round(F.avg("avg_temp"), 6).alias("avg_temp"))
    j = y.join(p, ["country", "year"]).join(r, ["short", "year"]).join(t, ["short", "year"])
    return j.select(F.monotonically_increasing_id().alias("Unnamed: 0"), F.col("country").alias("Area"),
                    F.col("fao_crop").alias("Item"), F.col("year").alias("Year"),
                    F.col("fao_yield_hg_ha").alias("hg/ha_yield"),
                    F.col("fao_rainfall_mm").alias("average_rain_fall_mm_per_year"),
                    F.col("fao_pesticides_tonnes").alias("pesticides_tonnes"), "avg_temp")


def export_premerged(c):
    return L.write_csv(premerged(c), shared_path(c.spark, "raw_premerged"))


view("premerged", f"""
select y.country, y.fao_crop as crop, y.year, y.fao_yield_hg_ha as yield_hg_ha, r.fao_rainfall_mm as rainfall_mm,
  p.fao_pesticides_tonnes as pesticides_tonnes, t.avg_temp
from ref_yield y join ref_pest p on y.country = p.country and y.year = p.year
join ref_rain r on replace(y.country, 'NATION_', 'N') = r.country and y.year = r.year
join (select country, year, {sql_np_round('avg(avg_temp)', 6)} as avg_temp from ref_temp group by 1, 2) t
  on replace(y.country, 'NATION_', 'N') = t.country and y.year = t.year""")


@query("src_csv_scan", "select * from part", ops="S1")
def q_src_csv_scan(c):
    part = c.read("part")
    path = L.write_csv(part, shared_path(c.spark, "part_csv"))
    return L.read_delimited(c.spark, path, part.schema)


_OBS_SQL = "select " + ", ".join(RAW_OBS_HEADERS) + " from farm_obs"


@query("load_observations", _OBS_SQL, ops="S2 S1 P1 P3 P4")
def q_load_observations(c):
    return L.load_observations(c.spark, export_observations(c))


@query("load_ref_yield", "select country, fao_crop as crop, year, fao_yield_hg_ha as yield_hg_ha from ref_yield "
       "where fao_yield_hg_ha is not null", ops="S3 P2 P4 P5")
def q_load_ref_yield(c):
    return L.load_ref_yield(c.spark, export_ref_yield(c))


@query("load_ref_pesticides", "select country, year, fao_pesticides_tonnes as pesticides_tonnes from ref_pest",
       ops="S4")
def q_load_ref_pesticides(c):
    return L.load_ref_pesticides(c.spark, export_ref_pest(c))


@query("load_ref_rainfall", "select country, year, fao_rainfall_mm as rainfall_mm from ref_rain", ops="S5 P1")
def q_load_ref_rainfall(c):
    return L.load_ref_rainfall(c.spark, export_ref_rain(c))


@query("load_ref_temperature", "select country, year, avg_temp from ref_temp", ops="S6")
def q_load_ref_temperature(c):
    return L.load_ref_temperature(c.spark, export_ref_temp(c))


@query("load_premerged", "select * from premerged", ops="S7 P6")
def q_load_premerged(c):
    return L.load_premerged(c.spark, export_premerged(c)).select("country", "crop", "year", "yield_hg_ha", "rainfall_mm",
                                                  "pesticides_tonnes", "avg_temp")


def _summary_sql(name, table, cols):
    nulls = " + ".join(f"(count(*) - count({x}))" for x in cols)
    return (f"select '{name}' as \"table\", count(*) as n_rows, cast({len(cols)} as int) as n_cols, "
            f"cast({nulls} as bigint) as n_nulls from {table}")


@query("load_all_summary", "\nunion all ".join([
    _summary_sql("observations", "farm_obs", list(RAW_OBS_HEADERS)),
    _summary_sql("yield", "(select * from ref_yield where fao_yield_hg_ha is not null)",
                 ["country", "fao_crop", "year", "fao_yield_hg_ha"]),
    _summary_sql("pesticides", "ref_pest", ["country", "year", "fao_pesticides_tonnes"]),
    _summary_sql("rainfall", "ref_rain", ["country", "year", "fao_rainfall_mm"]),
    _summary_sql("temperature", "ref_temp", ["country", "year", "avg_temp"]),
    _summary_sql("premerged", "premerged", ["country", "crop", "year", "yield_hg_ha", "rainfall_mm", "pesticides_tonnes", "avg_temp"]),
]), ops="S8 A17")
def q_load_all_summary(c):
    return L.table_summary({
        "observations": L.load_observations(c.spark, export_observations(c)),
        "yield": L.load_ref_yield(c.spark, export_ref_yield(c)),
        "pesticides": L.load_ref_pesticides(c.spark, export_ref_pest(c)),
        "rainfall": L.load_ref_rainfall(c.spark, export_ref_rain(c)),
        "temperature": L.load_ref_temperature(c.spark, export_ref_temp(c)),
        "premerged": L.load_premerged(c.spark, export_premerged(c)),
    })


@query("sink_roundtrip", "select * from merged", ops="S9")
def q_sink_roundtrip(c):
    path = L.write_table(c.merged, shared_path(c.spark, "merged"))
    return c.spark.read.parquet(path)


def _constants_text() -> str:
    """The agronomic constants behind the features, as name.key=value text."""
    tables = {"CROP_OPTIMAL_RAINFALL_MM": D.CROP_OPTIMAL_RAINFALL_MM, "CROP_MAX_TEMP_C": D.CROP_MAX_TEMP_C,
              "CROP_BASE_TEMP_C": D.CROP_BASE_TEMP_C, "SOIL_QUALITY_SCORE": D.SOIL_QUALITY_SCORE}
    return ",".join(f"{n}.{k}={v}" for n, t in tables.items() for k, v in t.items())


@query("metadata_sidecar", f"""
select count(*) as rows, cast({len(D.MERGED_COLUMNS)} as bigint) as n_cols,
  '{",".join(D.MERGED_COLUMNS)}' as cols,
  array_to_string(list_sort(list(distinct crop)), ',') as crops,
  (select array_to_string(list_sort(list(distinct crop)), ',') from
     (select crop from farm_obs except select crop from merged)) as crops_excluded,
  array_to_string(list_sort(list(distinct cast(year as varchar))), ',') as years,
  'yield_hg_ha' as target,
  cast(""" + " + ".join(f"(count(*) - count({x}))" for x in D.MERGED_COLUMNS) + """ as bigint) as total_nulls,
  """ + " || ',' || ".join(f"'{x}=' || (count(*) - count({x}))" for x in D.MERGED_COLUMNS) + f""" as null_counts,
  cast({len(D.FEATURES)} as bigint) as n_features, '{",".join(D.FEATURES)}' as feature_cols, '{_constants_text()}' as domain_constants
from merged""", ops="S10")
def q_metadata_sidecar(c):
    m = c.merged
    nulls = None
    for x in m.columns:
        t = F.sum(F.col(x).isNull().cast("long"))
        nulls = t if nulls is None else nulls + t
    excluded = c.farm_obs.select("crop").subtract(m.select("crop"))
    # crop and year sets are closed domains (4 crops, the reference years)
    meta = m.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(m.columns)).cast("long").alias("n_cols"),
        F.lit(",".join(m.columns)).alias("cols"),
        F.array_join(F.array_sort(F.collect_set("crop")), ",").alias("crops"),
        F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"),
        F.lit(D.TARGET).alias("target"), nulls.cast("long").alias("total_nulls"),
        F.concat_ws(",", *[F.concat(F.lit(f"{x}="), F.sum(F.col(x).isNull().cast("long")).cast("string")) for x in m.columns])
        .alias("null_counts"),
        F.lit(len(D.FEATURES)).cast("long").alias("n_features"), F.lit(",".join(D.FEATURES)).alias("feature_cols"),
        F.lit(_constants_text()).alias("domain_constants"))
    meta = meta.withColumn("crops_excluded", excluded.agg(
        F.array_join(F.array_sort(F.collect_set("crop")), ",")).scalar())
    path = shared_path(c.spark, "merged_meta")
    meta.write.mode("overwrite").json(path)
    return c.spark.read.json(path)


_FAO = ["fao_yield_hg_ha", "fao_rainfall_mm", "fao_pesticides_tonnes", "fao_avg_temp"]


@query("ref_from_merged", "select crop, " + ", ".join(f"min({x}) as {x}" for x in _FAO)
       + " from merged group by crop", ops="S11 A5")
def q_ref_from_merged(c):
    path = L.write_table(c.merged, shared_path(c.spark, "merged"))
    pruned = c.spark.read.parquet(path).select("crop", *_FAO)  # pruned Parquet scan
    return group_first(pruned, ["crop"], _FAO)


@query("ref_constants", "select crop, fao_yield_hg_ha, fao_rainfall_mm, fao_avg_temp from lookup_ref", ops="S12")
def q_ref_constants(c):
    lk = c.lookup_ref_year
    # the lookup has one row per mapped crop: the map has at most 4 entries
    refs = lk.agg(F.map_from_entries(F.collect_list(F.struct("crop", "fao_yield_hg_ha"))).alias("fao_yield_hg_ha"),
                  F.min("fao_rainfall_mm").alias("fao_rainfall_mm"), F.min("fao_avg_temp").alias("fao_avg_temp"))
    path = shared_path(c.spark, "fao_refs")
    refs.write.mode("overwrite").json(path)
    back = c.spark.read.schema("fao_yield_hg_ha map<string,double>, fao_rainfall_mm double, fao_avg_temp double") \
        .json(path)
    return back.select(F.explode("fao_yield_hg_ha").alias("crop", "fao_yield_hg_ha"), "fao_rainfall_mm", "fao_avg_temp")


@query("stage_materialize", "select * from merged", ops="S15")
def q_stage_materialize(c):
    path = shared_path(c.spark, "stage_merged")
    L.materialize(c.merged, path)                      # first run writes
    return L.materialize(c.merged, path, skip_if_exists=True)  # second run reads
