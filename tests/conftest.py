import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leafwise.session import get_session

    s = get_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield s
