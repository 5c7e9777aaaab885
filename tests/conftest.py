import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import get_spark
    s = get_spark("local[4]", 4)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
