"""Registered queries vs the DuckDB oracle at sf0.01 (the driver's check).

A representative subset runs by default; HARVESTRY_ORACLE=all runs every
registered query that has oracle SQL."""

import os

import pytest

from harvestry.plans.oracle import compare, duckdb_connect, run_oracle
from harvestry.plans.registry import load_all, oracle_text
from tests.conftest import SF_CHECK

SUBSET = ["merge_datasets", "build_reference_lookup", "build_features", "recommend_crops", "optimize_best",
          "sensitivity_rainfall", "describe_numeric", "group_median", "boxplot_stats", "null_audit",
          "validate_conditions", "corr_with_target", "mutual_information", "sample_exact", "category_overlap",
          "load_observations", "stream_score", "stream_validate", "impute_group_median", "mean_rank"]
REG = load_all()
NAMES = [n for n, q in REG.items() if q.sql] if os.environ.get("HARVESTRY_ORACLE") == "all" else SUBSET


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_CHECK)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, catalog, con, name):
    q = REG[name]
    got = q.build(catalog).toPandas()
    want = run_oracle(con, oracle_text(q.sql))
    cmp = compare(got, want)
    assert cmp.ok, cmp.detail
