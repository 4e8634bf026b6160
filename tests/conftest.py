import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import local_session  # noqa: E402

SF_SMALL = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
SF_ORACLE = os.environ.get("TESSERA_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="tessera-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture(scope="session")
def sf_oracle():
    return SF_ORACLE
