"""Exact quantiles with bounded task memory.

``F.percentile`` / ``F.median`` are exact, but each group's aggregation
buffer holds every distinct value of the group in one task. ``exact_quantiles``
works on value counts instead:

1. count every (group, value) with a two-phase aggregate: a value that fills
   most rows is one row per map task, and the data is shuffled once;
2. range-partition the counts by (group, value) and write them with their
   partition number to the shared folder. The keys are distinct, so a hot
   group splits by value and no value can fill a partition;
3. the rank before each value is its partition's offset in the group (a window
   over one row per group and partition) plus a running sum inside it;
4. pick the values at the two ranks around each probability and interpolate
   linearly, like ``percentile`` / DuckDB ``quantile_cont`` / numpy ``linear``.

The result equals ``percentile`` exactly (same interpolation formula). The
counts are written when the function is called; later steps read those files.
``quantiles_builtin`` uses ``F.percentile`` for inputs known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.session import shared_path


def _names(probs: Sequence[float], names: Sequence[str] | None) -> list[str]:
    return list(names) if names else [f"q{int(round(p * 100)):02d}" for p in probs]


def quantiles_builtin(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                      names: Sequence[str] | None = None) -> DataFrame:
    out = _names(probs, names)
    aggs = [F.percentile(F.col(value), float(p)).alias(n) for p, n in zip(probs, out)]
    return df.groupBy(*by).agg(*aggs)


def value_counts_ranged(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, __x, __n, __p): rows per distinct non-null value, range-partitioned, ``__p`` the partition."""
    counts = (df.select(*by, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
              .groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n")))
    ranged = counts.repartitionByRange(*by, "__x").withColumn("__p", F.spark_partition_id())
    path = shared_path(df.sparkSession, "value-counts")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability. Groups with only
    null values are dropped; a null group is a group."""
    by = list(by)
    ranged = value_counts_ranged(df, value, by)
    # at most one row per group and range partition
    parts = ranged.groupBy(*by, "__p").agg(F.sum("__n").alias("__c"))
    ahead = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__p").alias("__bp"),
                         F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__before"),
                         F.sum("__c").over(Window.partitionBy(*by)).alias("__all"))
    same = F.col("__p") == F.col("__bp")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    inside = Window.partitionBy(*by, "__p").orderBy("__x")
    ranked = (ranged.withColumn("__upto", F.sum("__n").over(inside)).join(parts, same)
              .withColumn("__end", F.col("__before") + F.col("__upto")))

    def at(rank):
        return F.min(F.when((F.col("__end") - F.col("__n") <= rank) & (rank < F.col("__end")), F.col("__x")))

    picks, results = [], []
    for i, (p, name) in enumerate(zip(probs, _names(probs, names))):
        position = F.lit(float(p)) * (F.col("__all") - 1)
        lower, higher = F.floor(position), F.ceil(position)
        picks += [at(lower).alias(f"__lo{i}"), at(higher).alias(f"__hi{i}"), F.max(position).alias(f"__at{i}")]
        at_, lo, hi = F.col(f"__at{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append(F.when(F.floor(at_) == F.ceil(at_), lo)
                       .otherwise((F.ceil(at_) - at_) * lo + (at_ - F.floor(at_)) * hi).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *results)
