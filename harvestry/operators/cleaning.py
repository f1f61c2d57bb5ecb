"""Projections, filters and cleaning steps (all narrow, no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from harvestry.functions.numeric import case_map, clip_lower as _clip, np_round


def normalize_columns(df: DataFrame, lower: bool = True) -> DataFrame:
    """Strip names; optionally lower-case and replace blanks with '_'."""
    def norm(c: str) -> str:
        c = c.strip()
        return c.lower().replace(" ", "_") if lower else c
    return df.toDF(*[norm(c) for c in df.columns])


def rename_select(df: DataFrame, mapping: Mapping[str, str], keep: list[str]) -> DataFrame:
    """Rename then keep a list of columns, in that order."""
    return df.withColumnsRenamed(dict(mapping)).select(*keep)


def parse_boolean(c: str | Column) -> Column:
    """Exactly 'True'/'False' text (or a boolean) -> boolean, anything else -> null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x == F.lit("True"), F.lit(True)).when(x == F.lit("False"), F.lit(False))


def parse_boolean_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """P3 on a frame: only text columns are parsed, boolean ones are kept."""
    types = dict(df.dtypes)
    return df.withColumns({c: parse_boolean(c) for c in cols if c in types and types[c] == "string"})


def coerce_numeric(c: str | Column) -> Column:
    """Text -> double, unparsable -> null (ANSI-safe ``try_cast``)."""
    x = F.col(c) if isinstance(c, str) else c
    return x.try_cast("double")


def drop_null_target(df: DataFrame, subset: list[str]) -> DataFrame:
    """P5."""
    return df.na.drop(subset=subset)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Absent names are ignored (as ``errors='ignore'``)."""
    return df.drop(*[c for c in cols if c in df.columns])


def map_values(df: DataFrame, column: str, mapping: Mapping | DataFrame, out: str | None = None,
               default=None, key: str = "key", value: str = "value") -> DataFrame:
    """Dictionary remap with an optional default.

    A literal dictionary becomes a CASE expression (constant-folded, no
    join); a mapping table becomes a left join whose strategy the planner picks
    from the table's size.
    """
    out = out or column
    if isinstance(mapping, DataFrame):
        m = mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
        j = df.join(m, F.col(column) == F.col("__k"), "left")
        v = F.coalesce(F.col("__v"), F.lit(default)) if default is not None else F.col("__v")
        return j.withColumn(out, v).drop("__k", "__v")
    return df.withColumn(out, case_map(column, mapping, default))


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Numpy-rule rounding of several columns."""
    return df.withColumns({c: np_round(c, n) for c, n in digits.items()})


def convert_units(c: str | Column, factor: float, divide: bool = False) -> Column:
    """t/ha -> hg/ha multiplies by 10000; hg/ha -> t/ha divides by it
    (a division, not a multiplication by 1e-4: the two round differently)."""
    x = F.col(c) if isinstance(c, str) else c
    return x / F.lit(float(factor)) if divide else x * F.lit(float(factor))


def search_names(c: str | Column, needle: str) -> Column:
    """Case-insensitive substring test, null -> false."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(x).contains(needle.lower()), F.lit(False))


def bool_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    """P15."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def log_target(c: str | Column) -> Column:
    """log(1 + x)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.log1p(x)


def numeric_columns(df: DataFrame) -> list[str]:
    """P20: names of numeric columns (booleans excluded, as pandas does)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def clip_lower(c: str | Column, lower: float = 0.0) -> Column:
    """P21."""
    return _clip(c, lower)
