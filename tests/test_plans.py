"""Plan-shape guards for the scale properties the design relies on."""

import pytest

from harvestry.plans.catalog import Catalog
from harvestry.plans.registry import load_all
from tests.conftest import SF_SMALL

REG = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    return Catalog(spark, SF_SMALL)


def test_merge_broadcasts_lookup_and_never_shuffles_observations(small):
    plan = _plan(small.merged)
    assert "BroadcastExchange" in plan
    # the only exchanges are inside the lookup / dimension sides, never on crop
    assert "hashpartitioning(crop" not in plan


def test_recommendation_is_shuffle_free(small):
    plan = _plan(REG["recommend_crops"].build(small))
    assert "Exchange hashpartitioning" not in plan or plan.count("Exchange hashpartitioning") == \
        _plan(small.scenarios).count("Exchange hashpartitioning")
    assert "Window" not in plan and "Sort [" not in plan


def test_grid_search_has_one_aggregate_shuffle(small):
    base = _plan(small.scenarios).count("Exchange hashpartitioning")
    plan = _plan(REG["optimize_best"].build(small))
    assert plan.count("Exchange hashpartitioning") == base + 1


def test_filters_reach_scans(small):
    # the country filter on the aggregated view is pushed below the aggregate
    # and the joins, into the nation scan
    plan = _plan(REG["filter_country_years"].build(small))
    assert "EqualTo(n_name,NATION_3)" in plan


def test_column_pruning(small):
    plan = _plan(REG["value_counts"].build(small))
    lineitem_schema = [line for line in plan.splitlines() if "lineitem" in line]
    assert lineitem_schema and all("l_shipdate" not in line for line in lineitem_schema)


@pytest.mark.parametrize("name", [n for n, q in REG.items() if q.sql])
def test_no_cross_join(small, name):
    plan = _plan(REG[name].build(small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
