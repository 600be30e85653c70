import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shopflow.session import build_session
    s = build_session("local[4]", "shopflow-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="shopflow-test-ckpt-"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf0001():
    return "/root/testdata/sf0.001"
