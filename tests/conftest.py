import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidecast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def make(spark):
    """history from {series: [(day offset or date, y), ...]}"""

    def build(series, start=dt.date(2021, 1, 1)):
        rows = [
            (s, start + dt.timedelta(days=int(k)) if not isinstance(k, dt.date) else k, float(y))
            for s, values in series.items() for k, y in values
        ]
        return spark.createDataFrame(rows, "series_id string, ds date, y double")

    return build


@pytest.fixture(scope="session")
def wanted(spark):
    def build(*pairs):
        return spark.createDataFrame(list(pairs), "series_id string, target_ds date")

    return build


@pytest.fixture(scope="session")
def two_years(make):
    """800 days with a weekly and a yearly pattern, Feb 29 inside, in two series."""
    import numpy as np

    rng, t = np.random.default_rng(7), np.arange(800)
    base = 300 + 0.05 * t + 40 * np.sin(2 * np.pi * t / 7) + 60 * np.sin(2 * np.pi * t / 365.25)
    a, b = base + rng.normal(0, 10, 800), 2 * base + rng.normal(0, 30, 800)
    return make(
        {"a": list(zip(t, np.round(a, 3))), "b": list(zip(t, np.round(b, 3)))}, start=dt.date(2019, 1, 1)
    ).persist()
