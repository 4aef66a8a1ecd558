import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from groupsight.session import local_session, ship_package

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
