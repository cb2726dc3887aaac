import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trendlab.session import local_session  # noqa: E402
from trendlab.sources import sinks  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session(cpus=8, memory="8g", app="trendlab-tests", checkpoint_dir=shared)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    sinks.release(session)
    left = list(Path(shared).glob("*/*"))
    session.stop()
    assert not left, f"intermediates left behind: {left}"


@pytest.fixture(scope="session")
def weekdays():
    """``weekdays("2024-01-01", 5)``: that many weekdays from a date on."""

    def make(start, n):
        day, out = dt.date.fromisoformat(start), []
        while len(out) < n:
            if day.weekday() < 5:
                out.append(day)
            day += dt.timedelta(days=1)
        return out

    return make


@pytest.fixture(scope="session")
def long_prices(spark):
    """Long price table from ``{symbol: [values]}`` over dates."""

    def make(days, columns, value="close", key="symbol"):
        rows = [(s, d, None if v is None else float(v)) for s, vs in columns.items() for d, v in zip(days, vs, strict=True)]
        return spark.createDataFrame(rows, f"{key} string, ts date, {value} double")

    return make
