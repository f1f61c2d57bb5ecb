"""Grouped statistics. Every aggregate is two-phase (partial
aggregation before the shuffle); quantiles use the sort-based exact operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.numeric import case_map, np_round
from harvestry.operators.quantiles import exact_quantiles


def group_mean(df: DataFrame, by: Sequence[str], value: str, digits: int | None = 2, alias: str | None = None) -> DataFrame:
    """A1: mean per group (numpy rounding)."""
    m = F.avg(value)
    return df.groupBy(*by).agg((np_round(m, digits) if digits is not None else m).alias(alias or value))


def group_median(df: DataFrame, by: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    """A2: exact median per group, sorted descending."""
    return exact_quantiles(df, value, [0.5], by, [alias]).orderBy(F.desc(alias), *by)


def group_count_mean(df: DataFrame, by: Sequence[str], values: Sequence[str], digits: int = 0) -> DataFrame:
    """A3: ``[count, mean]`` per value column, rounded."""
    aggs = []
    for v in values:
        aggs += [F.count(v).alias(f"{v}_count"), np_round(F.avg(v), digits).alias(f"{v}_mean")]
    return df.groupBy(*by).agg(*aggs)


def yearly_trend(df: DataFrame, year: str, value: str) -> DataFrame:
    """A4: mean and exact median per year."""
    means = df.groupBy(year).agg(F.avg(value).alias("mean"))
    med = exact_quantiles(df, value, [0.5], [year], ["median"])
    return means.join(med, year, "left")


def group_first(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A5: one non-null value per group. Rows have no order here, so it is the
    smallest, which is the first wherever a group's values are constant."""
    return df.groupBy(*by).agg(*[F.min(v).alias(v) for v in values])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, descending (ties by value)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct count of several columns in one aggregate."""
    return df.agg(*[F.countDistinct(c).alias(f"{c}_nunique") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values (distributed ``distinct`` then a sort)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A9."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def pivot_mean(df: DataFrame, row: str, col: str, values: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """A10: row x col table of means; the pivot values are explicit, so no
    job is needed to discover them."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.avg(value))
    return p.select(row, *[np_round(v, digits).alias(v) for v in values])


def long_format(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``columns`` (cast to double) into (name, value) rows."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), name, value)


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Count, mean, std (ddof 1), min, exact quartiles, max per column.

    The table is unpivoted once, so all columns share one aggregate and one
    quantile sort keyed by column name.
    """
    lf = long_format(df, columns)
    basic = lf.groupBy("column").agg(
        F.count("value").alias("count"), np_round(F.avg("value"), digits).alias("mean"),
        np_round(F.stddev_samp("value"), digits).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(lf, "value", [0.25, 0.5, 0.75], ["column"], ["p25", "p50", "p75"])
    q = q.select("column", *[np_round(c, digits).alias(c) for c in ("p25", "p50", "p75")])
    return basic.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, unique, top (most frequent, ties by value), freq."""
    lf = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = lf.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    top = counts.groupBy("column").agg(
        F.sum("freq").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("freq")).alias("nf"), F.col("value").alias("v"))).alias("_m"))
    return top.select("column", "count", "unique", F.col("_m.v").alias("top"), (-F.col("_m.nf")).alias("freq"))


def practice_impact(df: DataFrame, flag: str, value: str, digits: int = 4) -> DataFrame:
    """Mean by flag and the lift (mean when true minus mean when false)."""
    return df.agg(
        np_round(F.avg(F.when(F.col(flag), F.col(value))), digits).alias("mean_with"),
        np_round(F.avg(F.when(~F.col(flag), F.col(value))), digits).alias("mean_without"),
        np_round(F.avg(F.when(F.col(flag), F.col(value))) - F.avg(F.when(~F.col(flag), F.col(value))), digits)
        .alias("lift"))


def feature_summary(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Dtype, unique, min, mean, max, std (ddof 1) per column, one pass."""
    dtypes = dict(df.dtypes)
    lf = long_format(df, columns)
    agg = lf.groupBy("column").agg(
        F.countDistinct("value").alias("unique"), F.min("value").alias("min"),
        np_round(F.avg("value"), digits).alias("mean"), F.max("value").alias("max"),
        np_round(F.stddev_samp("value"), digits).alias("std"))
    dtype = case_map("column", {c: dtypes[c] for c in columns})
    return agg.select("column", dtype.alias("dtype"), "unique", "min", "mean", "max", "std")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with ``is_constant`` (no variance, nulls ignored)."""
    lf = long_format(df, columns)
    return lf.groupBy("column").agg((F.min("value") == F.max("value")).alias("is_constant"))
