import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarrykit.session import local_session, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = ship(local_session(4, "tests"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
