"""Request bounds and domains (mirrors the reference's schema and engine tests)."""

import pytest

from harvestry.operators.validation import validate

BASE = dict(scenario_id="s", crop="Maize", rainfall_mm=650.0, temperature_celsius=22.0, days_to_harvest=120,
            region="East", soil_type="Loam", weather_condition="Sunny", fertilizer_used=True, irrigation_used=True)
SCHEMA = ("scenario_id string, crop string, rainfall_mm double, temperature_celsius double, days_to_harvest int, "
          "region string, soil_type string, weather_condition string, fertilizer_used boolean, irrigation_used boolean")


def _check(spark, check_crop=False, **kw):
    row = {**BASE, **kw}
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    return validate(df, check_crop=check_crop).first()


@pytest.mark.parametrize("field,value", [("rainfall_mm", 0.0), ("rainfall_mm", 5000.0),
                                         ("temperature_celsius", -10.0), ("temperature_celsius", 50.0),
                                         ("days_to_harvest", 1), ("days_to_harvest", 365)])
def test_accepted_limits(spark, field, value):
    assert _check(spark, **{field: value})["is_valid"]


@pytest.mark.parametrize("field,value", [("rainfall_mm", -1.0), ("rainfall_mm", 5001.0),
                                         ("temperature_celsius", -11.0), ("temperature_celsius", 51.0),
                                         ("temperature_celsius", -15.0), ("temperature_celsius", 55.0),
                                         ("days_to_harvest", 0), ("days_to_harvest", 366),
                                         ("region", "Central"), ("soil_type", "Gravel"),
                                         ("weather_condition", "Windy")])
def test_rejected(spark, field, value):
    r = _check(spark, **{field: value})
    assert not r["is_valid"] and len(r["reasons"]) == 1


@pytest.mark.parametrize("crop", ["Barley", None])
def test_crop_domain(spark, crop):
    assert not _check(spark, check_crop=True, crop=crop)["is_valid"]


def test_flags_default_true(spark):
    r = _check(spark, fertilizer_used=None, irrigation_used=None)
    assert r["fertilizer_used"] is True and r["irrigation_used"] is True
