"""Cleaning and loading edge cases (FIXTURES §4)."""

import os
import uuid

from pyspark.sql import functions as F

from harvestry.operators.cleaning import coerce_numeric, normalize_columns, parse_boolean
from harvestry.operators.joins import clean_observations
from harvestry.sources.loaders import load_ref_rainfall, read_delimited


def test_cleaner_drops_only_negative_target(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (None,)], "yield_tons_per_hectare double")
    out = sorted((r[0] is None, r[0]) for r in clean_observations(df).collect())
    assert out == [(False, 0.0), (True, None)]


def test_boolean_text(spark):
    df = spark.createDataFrame([("True",), ("False",), ("true",), ("yes",), (None,)], "t string")
    assert [r["v"] for r in df.select(parse_boolean("t").alias("v")).collect()] == [True, False, None, None, None]


def test_numeric_text(spark):
    df = spark.createDataFrame([("12",), (" 12 ",), ("..",), ("abc",), ("",)], "t string")
    assert [r["v"] for r in df.select(coerce_numeric("t").alias("v")).collect()] == [12.0, 12.0, None, None, None]


def test_header_blanks_stripped(spark, tmp_path):
    p = tmp_path / "rain.csv"
    p.write_text(" Area,Year,average_rain_fall_mm_per_year\nN3,2001,123.5\nN3,2002,..\n")
    df = load_ref_rainfall(spark, str(p))
    assert df.columns == ["country", "year", "rainfall_mm"]
    assert sorted((r.year, r.rainfall_mm) for r in df.collect()) == [(2001, 123.5), (2002, None)]


def test_latin1_fallback(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes(b"Area,Year\nC\xf4te d'Ivoire,2001\n")
    df = read_delimited(spark, str(p))
    assert df.first()["Area"] == "Côte d'Ivoire"


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Soil Type` int, ` Crop ` int")
    assert normalize_columns(df).columns == ["soil_type", "crop"]


def test_duplicate_right_key_fans_out(spark):
    left = spark.createDataFrame([(2001,)], "year int")
    right = spark.createDataFrame([(2001, 1.0), (2001, 2.0)], "year int, v double")
    assert left.join(right, "year", "left").count() == 2
