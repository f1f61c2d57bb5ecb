import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harvestry.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", partitions=8, app="harvestry-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from harvestry.plans.catalog import Catalog
    return Catalog(spark, SF_CHECK)
