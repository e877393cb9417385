import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

from lethe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("lethe-tests", os.environ.get("TEST_CPUS", "8"))


@pytest.fixture(autouse=True)
def default_partitions(spark):
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
