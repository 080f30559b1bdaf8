import pathlib
import sys
from datetime import date, timedelta

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from panelcast.schema import PanelData  # noqa: E402
from panelcast.session import local_session  # noqa: E402

PANEL = "store_id string, date date, visitors double"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, spark__default__parallelism=4)


@pytest.fixture(scope="session")
def panel_rows():
    """Three stores, five months, about one day in twenty missing."""
    rng = np.random.default_rng(0)
    rows = []
    for i, store in enumerate(("a", "b", "c")):
        for n in range(152):
            if n not in (0, 151) and rng.random() < 0.05:
                continue
            base = 10 * (i + 1) + 5 * np.sin(2 * np.pi * n / 7) + rng.normal()
            rows.append((store, date(2016, 1, 1) + timedelta(days=n), float(max(0, round(base)))))
    return rows


@pytest.fixture(scope="session")
def data(spark, panel_rows):
    reservations = spark.createDataFrame(
        [("a", date(2016, 1, 10), 5, 2.0), ("b", date(2016, 1, 11), 3, 1.0)],
        "store_id string, visit_date date, reserve_visitors bigint, lead_time_days double",
    )
    stores = spark.createDataFrame(
        [
            ("a", "cafe", "North Ward One", 1.0, 2.0),
            ("b", "bar", "North Side Two", 1.0, 2.0),
            ("c", "grill", "South Ward One", 1.0, 2.0),
        ],
        "store_id string, genre string, area string, lat double, lon double",
    )
    holidays = spark.createDataFrame(
        [(date(2016, 1, 1), 1), (date(2016, 1, 11), 1)], "date date, is_holiday int"
    )
    return PanelData(spark.createDataFrame(panel_rows, PANEL), reservations, stores, holidays)


def ramp(spark, n, store="s", first=10.0, start=date(2016, 1, 1)):
    rows = [(store, start + timedelta(days=i), first + i) for i in range(n)]
    return spark.createDataFrame(rows, PANEL)
