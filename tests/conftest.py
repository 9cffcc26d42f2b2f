import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from outletlens.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="outletlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from compare import duck
    from paths import SF01
    return duck(SF01)


@pytest.fixture(scope="session")
def duck001():
    from compare import duck
    from paths import SF001
    return duck(SF001)
