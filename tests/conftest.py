import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanlake import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "spanlake-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spanlake-test-checkpoint-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
