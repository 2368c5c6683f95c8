import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from homerange.session import checkpoint_dir, get_spark

    s = get_spark("*", shuffle_partitions=8, app="homerange-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from tests.compare import duck

    return duck(SF_SMALL)
