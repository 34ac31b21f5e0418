import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from gapmend import local_session
    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import check
    return check.connect(sf)


@pytest.fixture(scope="session")
def series(spark):
    """Six random series of 90 steps in two data sets, and their arrays."""
    import numpy as np
    rng = np.random.default_rng(3)
    data = {(ds, i): np.cumsum(rng.normal(size=90)) if i % 2 else rng.normal(size=90) for ds in ("a", "b") for i in range(3)}
    rows = [(ds, i, t, float(v)) for (ds, i), x in data.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "dataset string, series_id bigint, t bigint, value double"), data
