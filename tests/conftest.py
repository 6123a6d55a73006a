import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("8")


@pytest.fixture(scope="session")
def listings(spark):
    from tagwright.sources.tables import listings as build
    from tagwright.storage import store

    return store(build(spark, SMALL), "listings")
