import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from velobus.session import local_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("VELOBUS_TEST_SF", f"{TESTDATA}/sf0.001")
