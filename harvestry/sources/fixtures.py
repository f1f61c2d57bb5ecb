"""Derived test views over the driver tables.

The driver ships TPC-H-like tables only; these views give them the shape of
the crop-yield sources (observations and four country/year reference series).
Each view exists twice: as DataFrame code (what the engine runs) and as SQL
text (what the DuckDB oracle runs). Both are pure functions of the tables, so
their size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import case_map

# --- fixed values: code -> category bindings of the test views ---------------
PART_CROP = {0: "Barley", 1: "Cotton", 2: "Maize", 3: "Rice", 4: "Soybean", 5: "Wheat"}
SUPP_REGION = {0: "East", 1: "North", 2: "South", 3: "West"}
PTYPE_SOIL = {"ECONOMY": "Chalky", "LARGE": "Clay", "MEDIUM": "Loam", "PROMO": "Peaty", "SMALL": "Sandy"}
SOIL_DEFAULT = "Silt"
RETURNFLAG_WEATHER = {"A": "Cloudy", "N": "Rainy"}
WEATHER_DEFAULT = "Sunny"
PART_FAO_ITEM = {0: "Potatoes", 1: "Sorghum", 2: "Maize", 3: "Rice, paddy", 4: "Soybeans", 5: "Wheat"}
COUNTRY_LONG = "NATION_3"
COUNTRY_SHORT = "N3"
YEAR_START, YEAR_END, REFERENCE_YEAR = 1995, 2001, 2001
RAIN_ABSENT_YEAR, RAIN_NULL_YEAR = 1998, 1999

OBS_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


class Tables:
    """Lazy, column-pruned readers of the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# farm_obs
# ---------------------------------------------------------------------------

def farm_obs(t: Tables) -> DataFrame:
    """Observation table: one row per line item, 14 columns."""
    l = t.read("lineitem")
    p = t.read("part").select("p_partkey", "p_type")
    fert = F.col("l_discount") >= F.lit(0.05)
    irri = F.col("l_linestatus") == F.lit("O")
    rain = F.lit(100.0) + (F.col("l_extendedprice") % F.lit(900.0))
    temp = F.lit(15.0) + F.col("l_quantity") / F.lit(2.0)
    yield_t = (
        F.lit(0.005) * rain + F.lit(0.02) * temp
        + F.when(fert, F.lit(1.5)).otherwise(F.lit(0.0))
        + F.when(irri, F.lit(1.2)).otherwise(F.lit(0.0))
        + (F.col("l_suppkey") % 7 - 3) * F.lit(0.5)
        + (F.col("l_tax") - F.lit(0.04)) * F.lit(10.0)
    )
    return (
        l.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            *OBS_KEY,
            case_map(F.col("l_partkey") % 6, PART_CROP).alias("crop"),
            case_map(F.col("l_suppkey") % 4, SUPP_REGION).alias("region"),
            case_map("p_type", PTYPE_SOIL, SOIL_DEFAULT).alias("soil_type"),
            case_map("l_returnflag", RETURNFLAG_WEATHER, WEATHER_DEFAULT).alias("weather_condition"),
            rain.alias("rainfall_mm"),
            temp.alias("temperature_celsius"),
            fert.alias("fertilizer_used"),
            irri.alias("irrigation_used"),
            (F.lit(60) + F.col("l_orderkey") % 90).cast("int").alias("days_to_harvest"),
            yield_t.alias("yield_tons_per_hectare"),
        )
    )


# ---------------------------------------------------------------------------
# reference series
# ---------------------------------------------------------------------------

def _orders_nation(t: Tables) -> DataFrame:
    o = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = t.read("customer").select("c_custkey", "c_nationkey")
    n = t.read("nation").select("n_nationkey", "n_name")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(n, F.col("c_nationkey") == F.col("n_nationkey")))


def ref_yield(t: Tables) -> DataFrame:
    l = t.read("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    j = l.join(_orders_nation(t), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        j.groupBy(
            F.col("n_name").alias("country"),
            case_map(F.col("l_partkey") % 6, PART_FAO_ITEM).alias("fao_crop"),
            F.year("o_orderdate").cast("int").alias("year"),
        ).agg(F.max("l_extendedprice").alias("fao_yield_hg_ha"))
    )


def ref_pest(t: Tables) -> DataFrame:
    l = t.read("lineitem").select("l_orderkey")
    j = l.join(_orders_nation(t), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        j.groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").cast("int").alias("year"))
        .agg(F.count(F.lit(1)).cast("double").alias("fao_pesticides_tonnes"))
    )


def ref_rain(t: Tables) -> DataFrame:
    j = _orders_nation(t).where(F.year("o_orderdate") != RAIN_ABSENT_YEAR)
    g = j.groupBy(
        F.replace(F.col("n_name"), F.lit("NATION_"), F.lit("N")).alias("country"),
        F.year("o_orderdate").cast("int").alias("year"),
    ).agg(F.max("o_totalprice").alias("_mx"))
    return g.select(
        "country", "year",
        F.when(F.col("year") == RAIN_NULL_YEAR, F.lit(None).cast("double"))
        .otherwise(F.col("_mx") / F.lit(500.0)).alias("fao_rainfall_mm"),
    )


def ref_temp(t: Tables) -> DataFrame:
    return _orders_nation(t).select(
        F.replace(F.col("n_name"), F.lit("NATION_"), F.lit("N")).alias("country"),
        F.year("o_orderdate").cast("int").alias("year"),
        (F.col("o_totalprice") / F.lit(20000.0)).alias("avg_temp"),
    )


# ---------------------------------------------------------------------------
# small literal tables (model constants, grid, coefficients)
# ---------------------------------------------------------------------------

# --- fixed values: scenario presets (id, crop, rain, temp, days, region, soil, weather, fert, irri)
SCENARIO_PRESETS = [
    (1, "Maize", 650.0, 22.0, 120, "East", "Loam", "Sunny", True, True),
    (2, "Rice", 250.0, 34.0, 100, "South", "Sandy", "Sunny", True, True),
    (3, "Soybean", 1100.0, 14.0, 150, "North", "Clay", "Rainy", False, False),
    (4, "Rice", 1200.0, 28.0, 130, "South", "Clay", "Rainy", True, True),
    (5, "Wheat", 400.0, 12.0, 240, "North", "Silt", "Cloudy", True, False),
    (6, "Soybean", 500.0, 24.0, 100, "West", "Sandy", "Sunny", False, True),
    (7, "Maize", 0.0, 0.0, 60, "West", "Peaty", "Cloudy", False, False),
]
SCENARIO_COLUMNS = ["scenario_id", "crop"] + D.CONDITION_COLUMNS

# --- fixed values: linear model used for scoring tests ------------------------
COEF_INTERCEPT = 46500.0
COEF_SCALAR_MEAN = [550, 27.5, .5, .5, 104.5, 61694, -165, 11.06, 275, 275, 13.75, 1, 7, 21, 5.6, .45, 1, 2200, 3]
COEF_SCALAR_STD = [260, 7.2, .5, .5, 26, 31000, 260, 7.2, 330, 330, 14.6, .707, 6, 12, 3.2, .3, 2.5, 1100, 1.29]
COEF_SCALAR_COEF = [6520, 300, 4130, 2500, -50, 120, 6520, 300, 900, 700, 150, 4757, -80, 60, 40, -400, -250, 90, 35]
COEF_ONE_HOT = {
    "crop": (.25, .433, [10, -20, 15, -5]),
    "region": (.25, .433, [4, -3, 2, -3]),
    "soil_type": (.1667, .3727, [-6, 3, 9, 1, -8, 1]),
    "weather_condition": (.3333, .4714, [-2, 5, -3]),
}


def coef_rows() -> list[tuple[str, float, float, float]]:
    """(feature, mean, std, coef) for the 36 features, in model order."""
    rows = [(f, float(m), float(s), float(c)) for f, m, s, c in
            zip(D.SCALAR_FEATURES, COEF_SCALAR_MEAN, COEF_SCALAR_STD, COEF_SCALAR_COEF)]
    for name, dom in D.ONE_HOT_DOMAINS:
        m, s, cs = COEF_ONE_HOT[name]
        rows += [(f"{name}_{v}", float(m), float(s), float(c)) for v, c in zip(dom, cs)]
    return rows


def coef_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(coef_rows(), "feature string, mean double, std double, coef double")


def benchmarks_df(spark: SparkSession) -> DataFrame:
    rows = [(c, float(D.BENCHMARK_YIELD_HG_HA[c]), D.BENCHMARK_RAINFALL_MM, D.BENCHMARK_AVG_TEMP,
             D.CROP_OPTIMAL_RAINFALL_MM[c], D.CROP_MAX_TEMP_C[c], D.CROP_BASE_TEMP_C[c]) for c in D.CROPS]
    return spark.createDataFrame(
        rows, "crop string, fao_yield_hg_ha double, fao_rainfall_mm double, fao_avg_temp double, "
              "opt_rain double, t_max double, t_base double")


def scenario_presets_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(f"S{r[0]}",) + r[1:] for r in SCENARIO_PRESETS],
        "scenario_id string, crop string, rainfall_mm double, temperature_celsius double, days_to_harvest int, "
        "region string, soil_type string, weather_condition string, fertilizer_used boolean, "
        "irrigation_used boolean")


def scenarios(t: Tables, obs: DataFrame | None = None) -> DataFrame:
    """Scenario batch: every observation's conditions plus the seven presets."""
    obs = farm_obs(t) if obs is None else obs
    from_obs = obs.select(
        F.concat_ws("-", *[F.col(k).cast("string") for k in OBS_KEY]).alias("scenario_id"),
        "crop", *D.CONDITION_COLUMNS)
    return from_obs.unionByName(scenario_presets_df(t.spark))


# ---------------------------------------------------------------------------
# SQL text of the same views (oracle side)
# ---------------------------------------------------------------------------

def _sql_case(expr, mapping, default=None):
    from harvestry.functions.numeric import sql_case_map
    return sql_case_map(expr, mapping, default)


SQL_RAIN = "(100.0e0 + l.l_extendedprice % 900.0e0)"
SQL_TEMP = "(15.0e0 + l.l_quantity / 2.0e0)"

SQL_VIEWS: dict[str, str] = {
    "farm_obs": f"""
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  {_sql_case('l.l_partkey % 6', PART_CROP)} as crop,
  {_sql_case('l.l_suppkey % 4', SUPP_REGION)} as region,
  {_sql_case('p.p_type', PTYPE_SOIL, SOIL_DEFAULT)} as soil_type,
  {_sql_case('l.l_returnflag', RETURNFLAG_WEATHER, WEATHER_DEFAULT)} as weather_condition,
  {SQL_RAIN} as rainfall_mm,
  {SQL_TEMP} as temperature_celsius,
  l.l_discount >= 0.05e0 as fertilizer_used,
  l.l_linestatus = 'O' as irrigation_used,
  cast(60 + l.l_orderkey % 90 as int) as days_to_harvest,
  0.005e0*{SQL_RAIN} + 0.02e0*{SQL_TEMP}
   + case when l.l_discount >= 0.05e0 then 1.5e0 else 0.0e0 end
   + case when l.l_linestatus = 'O' then 1.2e0 else 0.0e0 end
   + (l.l_suppkey % 7 - 3) * 0.5e0 + (l.l_tax - 0.04e0) * 10.0e0 as yield_tons_per_hectare
from lineitem l join part p on l.l_partkey = p.p_partkey""",
    "ref_yield": f"""
select n.n_name as country,
  {_sql_case('l.l_partkey % 6', PART_FAO_ITEM)} as fao_crop,
  cast(year(o.o_orderdate) as int) as year, max(l.l_extendedprice) as fao_yield_hg_ha
from lineitem l join orders o on l.l_orderkey=o.o_orderkey
join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey
group by 1,2,3""",
    "ref_pest": """
select n.n_name as country, cast(year(o.o_orderdate) as int) as year,
  cast(count(*) as double) as fao_pesticides_tonnes
from lineitem l join orders o on l.l_orderkey=o.o_orderkey
join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey
group by 1,2""",
    "ref_rain": f"""
select replace(n.n_name,'NATION_','N') as country, cast(year(o.o_orderdate) as int) as year,
  case when year(o.o_orderdate)={RAIN_NULL_YEAR} then cast(null as double)
       else max(o.o_totalprice)/500.0e0 end as fao_rainfall_mm
from orders o join customer c on o.o_custkey=c.c_custkey
  join nation n on c.c_nationkey=n.n_nationkey
where year(o.o_orderdate) <> {RAIN_ABSENT_YEAR}
group by replace(n.n_name,'NATION_','N'), year(o.o_orderdate)""",
    "ref_temp": """
select replace(n.n_name,'NATION_','N') as country, cast(year(o.o_orderdate) as int) as year,
  o.o_totalprice/20000.0e0 as avg_temp
from orders o join customer c on o.o_custkey=c.c_custkey
  join nation n on c.c_nationkey=n.n_nationkey""",
}


def _sql_values(rows, cols):
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"cast({v!r} as double)"
        return f"cast({v} as int)"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) as v({', '.join(cols)})"


SQL_VIEWS["scenario_presets"] = _sql_values(
    [(f"S{r[0]}",) + r[1:] for r in SCENARIO_PRESETS],
    ["scenario_id", "crop", "rainfall_mm", "temperature_celsius", "days_to_harvest", "region", "soil_type",
     "weather_condition", "fertilizer_used", "irrigation_used"])
SQL_VIEWS["scenarios"] = (
    "select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as scenario_id, crop, "
    + ", ".join(D.CONDITION_COLUMNS) + " from farm_obs union all select * from scenario_presets")
SQL_VIEWS["benchmarks"] = _sql_values(
    [(c, float(D.BENCHMARK_YIELD_HG_HA[c]), D.BENCHMARK_RAINFALL_MM, D.BENCHMARK_AVG_TEMP,
      D.CROP_OPTIMAL_RAINFALL_MM[c], D.CROP_MAX_TEMP_C[c], D.CROP_BASE_TEMP_C[c]) for c in D.CROPS],
    ["crop", "fao_yield_hg_ha", "fao_rainfall_mm", "fao_avg_temp", "opt_rain", "t_max", "t_base"])
SQL_VIEWS["coef"] = _sql_values(coef_rows(), ["feature", "mean", "std", "coef"])
