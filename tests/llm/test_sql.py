"""Queries against their DuckDB SQL on a small table."""

import pytest

from harvestry.llm.queries import QUERIES, SQL
from harvestry.plans.oracle import compare, duckdb_connect, run_oracle
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    found = compare(QUERIES[name](spark, SF_SMALL).toPandas(), run_oracle(duckdb_connect(SF_SMALL), SQL[name]))
    assert found.ok, found.detail


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
