import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gondola.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("gondola-tests", cores=8)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables in {SF_DIR}")
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from checks.compare import connect

    return connect(sf_dir)


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    from gondola.testbed import Testbed

    return Testbed(spark, sf_dir).rollups()
