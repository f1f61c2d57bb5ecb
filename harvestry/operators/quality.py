"""Q1–Q14: data-quality audits. Each audit is one aggregate pass over the
table followed by an unpivot of its single result row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.numeric import np_round
from harvestry.operators.quantiles import exact_quantiles


def null_audit(df: DataFrame, only_with_nulls: bool = True, digits: int = 4) -> DataFrame:
    """Q1: per column null count and percent (one scan)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = one.unpivot(["__n"], cols, "column", "n_null")
    long = long.select("column", F.col("n_null").cast("long").alias("n_null"),
                       np_round(F.col("n_null") / F.col("__n") * F.lit(100.0), digits).alias("pct_null"))
    return long.where(F.col("n_null") > 0) if only_with_nulls else long


def null_total(df: DataFrame) -> DataFrame:
    """Q2: total number of null cells."""
    total = None
    for c in df.columns:
        term = F.sum(F.col(c).isNull().cast("long"))
        total = term if total is None else total + term
    return df.agg(total.cast("long").alias("total_nulls"))


def impute_group_median(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Q5: fill nulls with the exact median of the row's group (joined back)."""
    med = exact_quantiles(df, column, [0.5], by, ["__med"])
    return (df.join(med, list(by), "left")
              .withColumn(column, F.coalesce(F.col(column), F.col("__med"))).drop("__med"))


def duplicate_count(df: DataFrame, digits: int = 4) -> DataFrame:
    """Q6: exact duplicate rows (all columns), count and percent.

    Grouping by every column is a two-phase aggregate; the outer sum is a
    one-row aggregate."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.sum("__c").cast("long").alias("n_rows"), F.sum(F.col("__c") - 1).cast("long").alias("n_duplicates")) \
        .select("n_rows", "n_duplicates",
                np_round(F.col("n_duplicates") / F.col("n_rows") * F.lit(100.0), digits).alias("pct_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Q7."""
    return df.dropDuplicates()


def sparse_columns(df: DataFrame, threshold: float) -> list[str]:
    """Columns whose null share exceeds ``threshold``; one aggregate whose
    result has one value per column (bounded by the schema width)."""
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]).first()
    n = row["__n"] or 0
    return [c for c in df.columns if n and row[c] / n > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Q8: the output schema depends on the data, so the ratios are computed
    first (one small action), then the columns are dropped."""
    return df.drop(*sparse_columns(df, threshold))


def schema_profile(df: DataFrame, digits: int = 4) -> DataFrame:
    """Q9: dtype, nulls, null %, distinct count and a deterministic sample
    (the minimum as text) per column, from one aggregate."""
    cols = df.columns
    dtypes = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}"), F.countDistinct(c).alias(f"d{i}"),
                 F.min(F.col(c)).cast("string").alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                              F.col(f"n{i}").cast("long").alias("n_null"), F.col(f"d{i}").cast("long").alias("n_distinct"),
                              F.col(f"s{i}").alias("sample")) for i, c in enumerate(cols)])
    return one.select("__n", F.inline(rows)).select(
        "column", "dtype", "n_null", np_round(F.col("n_null") / F.col("__n") * F.lit(100.0), digits).alias("pct_null"),
        "n_distinct", "sample")


def name_mismatch_report(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Q12: distinct keys of each source, full outer join, one flag per source."""
    out = None
    for name, df in sources.items():
        d = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(f"in_{name}", F.lit(True))
        out = d if out is None else out.join(d, key, "full_outer")
    return out.select(key, *[F.coalesce(F.col(f"in_{n}"), F.lit(False)).alias(f"in_{n}") for n in sources])


def negative_report(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Q14: count, percent and summary of negative values (one aggregate)."""
    neg = F.col(column) < 0
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(neg, 1)).alias("n_negative"),
        np_round(F.count(F.when(neg, 1)) / F.count(F.lit(1)) * F.lit(100.0), digits).alias("pct_negative"),
        F.min(F.when(neg, F.col(column))).alias("min_negative"),
        F.max(F.when(neg, F.col(column))).alias("max_negative"),
        np_round(F.avg(F.when(neg, F.col(column))), digits).alias("mean_negative"))
