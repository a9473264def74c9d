import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pathweave.session import get_session

    s = get_session("local[*]", app="pathweave-tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="pw-test-")
