import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"
CHECK_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from souq.session import local_test_session
    s = local_test_session(8)
    yield s


@pytest.fixture(scope="session")
def sf_smoke():
    return SMOKE_DIR


def df_of(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)
