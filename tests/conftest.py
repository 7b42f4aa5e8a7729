import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import build_session
    s = build_session("local[4]", 4, app_name="rollcall-tests")
    yield s
    s.stop()


@pytest.fixture
def scratch():
    import tempfile
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
