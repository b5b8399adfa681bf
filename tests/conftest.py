import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from flowsmith.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, app_name="flowsmith-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from flowsmith.plans.oracle import duckdb_connection
    return duckdb_connection(SF_SMALL)
