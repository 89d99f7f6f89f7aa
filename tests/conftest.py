import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from mailsieve.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def hybrid(spark, sf_dir):
    from mailsieve.plans.queries import hybrid_model

    return hybrid_model(spark, sf_dir)
