"""Rounding, guarded division, clipping and remaps (FIXTURES §4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.functions.numeric import case_map, clip_lower, np_round, safe_div


def _one(spark, expr, schema="x double", rows=((1.0,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("v")).collect()


@pytest.mark.parametrize("x,n", [(0.125, 2), (2.5, 0), (3.5, 0), (2.675, 2), (-0.125, 2), (1234.5678, 1)])
def test_np_round_matches_numpy(spark, x, n):
    got = spark.createDataFrame([(x,)], "x double").select(np_round("x", n).alias("v")).first()["v"]
    assert got == float(np.round(x, n))


def test_round_half_even_examples(spark):
    df = spark.createDataFrame([(0.125, 2.5)], "a double, b double")
    r = df.select(np_round("a", 2).alias("a"), np_round("b", 0).alias("b")).first()
    assert r["a"] == 0.12 and r["b"] == 2.0


def test_safe_div_zero_is_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r["v"] for r in df.select(safe_div("a", "b").alias("v")).collect()] == [0.0, 2.0]


def test_clip_lower_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r["v"] for r in df.select(clip_lower("x").alias("v")).collect()] == [None, 0.0, 2.0]


def test_case_map_default(spark):
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    out = [r["v"] for r in df.select(case_map("x", {"a": "A"}, "Other").alias("v")).collect()]
    assert out == ["A", "Other"]


@pytest.mark.parametrize("x,n", [(-0.0, 2), (-0.001, 2), (-0.4, 0), (0.0, 1)])
def test_a_rounded_zero_is_positive_in_both_engines(spark, x, n):
    import duckdb

    from harvestry.functions.numeric import sql_np_round
    got = spark.createDataFrame([(x,)], "x double").select(np_round("x", n).alias("v")).first()["v"]
    sql = duckdb.sql(f"select {sql_np_round('x', n)} as v from (select {x!r}::double as x)").fetchall()[0][0]
    assert str(got) == "0.0" == str(sql)
