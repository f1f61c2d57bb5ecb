"""Exact cuts of the hash order against a plain sort."""

import hashlib

import pytest
from pyspark.sql import functions as F

from harvestry.operators import ranking as O


def order(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{k}{seed}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9, 10, 1003, 20_000])
def test_sizes_and_members(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    flag, fold = O.exact_split(df, F.col("k")), O.exact_folds(df, F.col("k"))
    rows = {r.k: (r.t, r.f) for r in df.select("k", flag.alias("t"), fold.alias("f")).collect()}
    ranked = order([str(i) for i in range(n)])
    n_test = (n + 4) // 5
    assert {k for k, (t, _) in rows.items() if t} == set(ranked[:n_test])
    sizes = [sum(f == k for _, f in rows.values()) for k in range(5)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sorted(sizes, reverse=True) == sizes
    assert [rows[k][1] for k in ranked] == sorted(f for _, f in rows.values())


def test_equal_keys_stay_together_and_null_keys_count(spark):
    df = spark.createDataFrame([("a",)] * 30 + [(None,)] * 7 + [(str(i),) for i in range(13)], "k string")
    rows = df.select("k", O.exact_folds(df, F.col("k")).alias("f"), O.exact_split(df, F.col("k")).alias("t")).distinct().collect()
    assert len(rows) == 15 and {r.f for r in rows} <= set(range(5))


def test_nothing_is_sorted(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    plan = df.select(O.exact_split(df, F.col("k")))._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Exchange" not in plan
