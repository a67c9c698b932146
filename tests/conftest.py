import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tripscope.session import build_session

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def slices_of(spark):
    """Builds a slices table from (metric, grain, entity, period, value, n) tuples."""

    def make(rows, coverage=1.0):
        data = [(m, g, e, dt.date.fromisoformat(p), v, n, n, coverage) for m, g, e, p, v, n in rows]
        return spark.createDataFrame(data, "metric_id string, grain string, entity string, period date, value double, n bigint, covered bigint, coverage double")

    return make
