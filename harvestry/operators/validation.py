"""Q10/Q11: domain validation of farm records, as reason arrays.

Nothing raises: each row gets the list of violated rules, so a batch (or a
stream) splits into accepted and rejected rows in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import domains as D


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))


def condition_rules(r="rainfall_mm", t="temperature_celsius", d="days_to_harvest", region="region",
                    soil="soil_type", weather="weather_condition", api_bounds: bool = True) -> list[tuple[Column, str]]:
    c = F.col
    rules = [
        (c(r).isNull() | (c(r) < 0), "rainfall_mm must be >= 0"),
        (c(t).isNull() | (c(t) < D.TEMP_MIN_C) | (c(t) > D.TEMP_MAX_C), "temperature_celsius must be in [-10, 50]"),
        (c(d).isNull() | (c(d) <= 0), "days_to_harvest must be > 0"),
        (~F.coalesce(c(region).isin(D.REGIONS), F.lit(False)), "region not in domain"),
        (~F.coalesce(c(soil).isin(D.SOIL_TYPES), F.lit(False)), "soil_type not in domain"),
        (~F.coalesce(c(weather).isin(D.WEATHER_CONDITIONS), F.lit(False)), "weather_condition not in domain"),
    ]
    if api_bounds:
        rules += [
            (c(r) > D.RAIN_MAX_MM, "rainfall_mm must be <= 5000"),
            (c(d) > D.DAYS_MAX, "days_to_harvest must be <= 365"),
        ]
    return rules


def crop_rule(crop="crop") -> tuple[Column, str]:
    return (~F.coalesce(F.col(crop).isin(D.CROPS), F.lit(False)), "crop not in domain")


def with_flag_defaults(df: DataFrame) -> DataFrame:
    """Management flags default to true when absent (request model rule)."""
    return df.withColumns({
        "fertilizer_used": F.coalesce(F.col("fertilizer_used"), F.lit(True)),
        "irrigation_used": F.coalesce(F.col("irrigation_used"), F.lit(True)),
    })


def validate(df: DataFrame, check_crop: bool = False, api_bounds: bool = True) -> DataFrame:
    """Adds ``reasons`` (array<string>) and ``is_valid``."""
    rules = condition_rules(api_bounds=api_bounds) + ([crop_rule()] if check_crop else [])
    return (with_flag_defaults(df)
            .withColumn("reasons", _reasons(rules))
            .withColumn("is_valid", F.size("reasons") == 0))


def valid_condition(check_crop: bool = False) -> Column:
    """Boolean expression: the row passes every rule (for a filter)."""
    rules = condition_rules() + ([crop_rule()] if check_crop else [])
    ok = F.lit(True)
    for cond, _ in rules:
        ok = ok & ~F.coalesce(cond, F.lit(False))
    return ok


def sql_condition_reasons(check_crop: bool = False) -> str:
    """The same rules in SQL: a '; '-joined reason string."""
    regions = ", ".join(f"'{x}'" for x in D.REGIONS)
    soils = ", ".join(f"'{x}'" for x in D.SOIL_TYPES)
    weathers = ", ".join(f"'{x}'" for x in D.WEATHER_CONDITIONS)
    crops = ", ".join(f"'{x}'" for x in D.CROPS)
    parts = [
        "case when rainfall_mm is null or rainfall_mm < 0 then 'rainfall_mm must be >= 0' end",
        "case when temperature_celsius is null or temperature_celsius < -10 or temperature_celsius > 50 "
        "then 'temperature_celsius must be in [-10, 50]' end",
        "case when days_to_harvest is null or days_to_harvest <= 0 then 'days_to_harvest must be > 0' end",
        f"case when not coalesce(region in ({regions}), false) then 'region not in domain' end",
        f"case when not coalesce(soil_type in ({soils}), false) then 'soil_type not in domain' end",
        f"case when not coalesce(weather_condition in ({weathers}), false) then 'weather_condition not in domain' end",
        "case when rainfall_mm > 5000 then 'rainfall_mm must be <= 5000' end",
        "case when days_to_harvest > 365 then 'days_to_harvest must be <= 365' end",
    ]
    if check_crop:
        parts.append(f"case when not coalesce(crop in ({crops}), false) then 'crop not in domain' end")
    return "concat_ws('; ', " + ", ".join(parts) + ")"
