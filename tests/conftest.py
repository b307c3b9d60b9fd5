import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ebbflow.session import local_session
    s = local_session("4", shuffle_partitions=8, app="ebbflow-tests")
    yield s


@pytest.fixture(scope="session")
def chain_small(spark):
    from ebbflow.plans.pipeline import Chain
    return Chain(spark, SF_SMALL)
