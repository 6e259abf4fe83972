from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tapeline.session import local_session  # noqa: E402

BAR = "ticker_code string, date date, open double, high double, low double, close double, adj_close double, volume long"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tapeline-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.sql.maxMetadataStringLength": "1000",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from adjusted closes: ``make_bars({"A": [100.0, None, ...]})``, one per day from ``start``."""
    def build(series, start=date(2020, 1, 1)):
        rows = []
        for code, prices in series.items():
            for i, p in enumerate(prices):
                values = (None,) * 5 if p is None else (float(p), p + 1.0, p - 1.0, float(p), float(p))
                rows.append((code, start + timedelta(days=i), *values, None if p is None else 1_000_000 + i))
        return spark.createDataFrame(rows, BAR)
    return build


@pytest.fixture(scope="session")
def rising(make_bars):
    """1,000 days rising by one a day from 100."""
    return make_bars({"005930.KS": [100.0 + i for i in range(1000)]})
