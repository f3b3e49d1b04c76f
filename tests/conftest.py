import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from metaloom.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "6", "spark.driver.memory": "3g", "spark.sql.autoBroadcastJoinThreshold": "64k"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
