"""Joins: lookup joins, the reference-lookup builder (J8) and the merge.

Broadcast policy: no side is broadcast on trust. The planner and AQE broadcast
a side whose size they know or have measured, and split skewed keys otherwise.
The reference lookup is written to the checkpoint folder first, so its real
size is known when the observations are joined to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import domains as D
from harvestry.functions.numeric import case_map, np_round
from harvestry.operators.quantiles import exact_quantiles

def filter_country_years(df: DataFrame, country: str, year_start: int, year_end: int,
                         country_col: str = "country", year_col: str = "year") -> DataFrame:
    """Equality + inclusive range filter (pushed to the scan / below aggregates)."""
    return df.where((F.col(country_col) == F.lit(country)) & F.col(year_col).between(year_start, year_end))


def impute_with_median(df: DataFrame, column: str, median_of: DataFrame | None = None, few_rows: bool = False) -> DataFrame:
    """Q3/Q4: fill nulls with the exact median of ``median_of`` (default: ``df``).

    The median is a scalar subquery and is not collected to the driver.
    ``few_rows`` takes the built-in median, whose buffer holds every distinct
    value in one task, for a frame known to be small.
    """
    src = df if median_of is None else median_of
    med = src.agg(F.median(column)).scalar() if few_rows else exact_quantiles(src, column, [0.5], [], ["m"]).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), med))


def build_reference_lookup(ref_yield: DataFrame, ref_pest: DataFrame, ref_rain: DataFrame,
                           ref_temp: DataFrame, *, country_yield: str, country_pest: str,
                           country_rain: str, country_temp: str, year_start: int, year_end: int,
                           item_map: dict[str, str] | None = None, materialize: bool = True) -> DataFrame:
    """One row per (crop, year) with the four reference values.

    Each source is filtered to its own spelling of the country; temperature is
    pre-aggregated to one mean per year; rainfall nulls are imputed with the
    median of the filtered rows, and years absent from rainfall with the median
    of the joined rows; only mapped items are kept.
    """
    item_map = item_map or D.FAO_TO_CROP
    y = (filter_country_years(ref_yield, country_yield, year_start, year_end)
         .select("fao_crop", "year", F.col("fao_yield_hg_ha").try_cast("double").alias("fao_yield_hg_ha")))
    p = (filter_country_years(ref_pest, country_pest, year_start, year_end)
         .select("year", F.col("fao_pesticides_tonnes").try_cast("double").alias("fao_pesticides_tonnes")))
    r = (filter_country_years(ref_rain, country_rain, year_start, year_end)
         .select("year", F.col("fao_rainfall_mm").try_cast("double").alias("fao_rainfall_mm")))
    r = impute_with_median(r, "fao_rainfall_mm", few_rows=True)  # one country's years
    t = (filter_country_years(ref_temp, country_temp, year_start, year_end)
         .groupBy("year")
         .agg(np_round(F.avg(F.col("avg_temp").try_cast("double")), 2).alias("fao_avg_temp")))
    t = impute_with_median(t, "fao_avg_temp", few_rows=True)
    # years repeated in a source fan out, as in any left join
    merged = y.join(p, "year", "left").join(r, "year", "left").join(t, "year", "left")
    if materialize:
        # at most items x years rows: written once to the shared checkpoint
        # folder, so the post-join median and the final projection read this
        # small table instead of re-scanning the large sources
        merged = merged.checkpoint(eager=True)
    merged = impute_with_median(merged, "fao_rainfall_mm", few_rows=True)
    return (
        merged.where(F.col("fao_crop").isin(list(item_map)))
        .select(
            case_map("fao_crop", item_map).alias("crop"),
            F.col("year").cast("int").alias("year"),
            np_round("fao_yield_hg_ha", 2).alias("fao_yield_hg_ha"),
            np_round("fao_rainfall_mm", 2).alias("fao_rainfall_mm"),
            np_round("fao_pesticides_tonnes", 2).alias("fao_pesticides_tonnes"),
            np_round("fao_avg_temp", 2).alias("fao_avg_temp"),
        )
    )


def clean_observations(df: DataFrame, target: str = "yield_tons_per_hectare") -> DataFrame:
    """Drop rows with a negative target; rows with a null target stay."""
    return df.where(~F.coalesce(F.col(target) < 0, F.lit(False)))


def merge_datasets(obs: DataFrame, lookup: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Clean observations, inner-join the reference lookup on crop, convert
    t/ha to hg/ha (2 digits) and pin the 15-column order.

    Any lookup will do: several years or rows of a crop fan out. The planner
    broadcasts one that it knows to be small, and then the observations are not
    shuffled.
    """
    joined = clean_observations(obs).join(lookup, "crop", "inner")
    return joined.select(
        *(keep or []),
        *[np_round(F.col("yield_tons_per_hectare") * F.lit(10000.0), 2).alias(c) if c == "yield_hg_ha"
          else F.col(c) for c in D.MERGED_COLUMNS])


def join_left_chain(left: DataFrame, rights: list[DataFrame], key: str) -> DataFrame:
    """Chained left equi-joins on one key."""
    out = left
    for r in rights:
        out = out.join(r, key, "left")
    return out


def crops_array() -> Column:
    return F.array(*[F.lit(c) for c in D.CROPS])


def grid_array(**labels: Callable[[Column, Column], Column]) -> Column:
    """The 60-point management grid as an array of structs, in search order; ``labels`` add columns made of both flags."""
    return F.array(*[
        F.struct(F.lit(f).alias("fertilizer_used"), F.lit(i).alias("irrigation_used"),
                 F.lit(d).alias("days_to_harvest"), *[make(F.lit(f), F.lit(i)).alias(n) for n, make in labels.items()])
        for f in D.GRID_FERTILIZER for i in D.GRID_IRRIGATION for d in D.GRID_DAYS])


def cross_crops(scenarios: DataFrame) -> DataFrame:
    """Every scenario paired with each of the four crops.

    A generator (``explode`` of a literal array) instead of a join: the
    expansion happens inside the scan's stage, with no exchange.
    """
    return scenarios.select("*", F.explode(crops_array()).alias("crop"))


def cross_grid(scenarios: DataFrame) -> DataFrame:
    """Every scenario paired with each of the 60 grid points, replacing
    the scenario's own management inputs."""
    base = [c for c in scenarios.columns if c not in ("fertilizer_used", "irrigation_used", "days_to_harvest")]
    return (scenarios.select(*base, F.posexplode(grid_array()).alias("grid_pos", "g"))
            .select(*base, "grid_pos", "g.fertilizer_used", "g.irrigation_used", "g.days_to_harvest"))
