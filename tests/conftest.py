import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from common import TRIALS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from riskloom.plans import catalog_ml
    from riskloom.session import get_session

    catalog_ml.PROFILE["fast"] = True  # models of 10 trees or rounds
    catalog_ml.SEARCH_TRIALS = TRIALS
    s = get_session("local[4]", app="riskloom-tests", shuffle_partitions=4)
    yield s
    s.stop()
