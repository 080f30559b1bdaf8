"""The feature matrix: one row per store day with every engineered column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.bookings import LEAD_MEAN, daily_bookings, default_bookings
from panelcast.operators.calendar import HOLIDAY_FLAGS, add_calendar, add_holidays
from panelcast.operators.entities import METADATA, add_entities
from panelcast.operators.history import add_history
from panelcast.operators.panel import densify
from panelcast.operators.smoothing import add_ewm
from panelcast.schema import DATE, KEYS, LAGS, ROLL_WINDOWS, STORE, TARGET, PanelData

CALENDAR = ("dow", "is_weekend", "month", "day_of_month", "doy_sin", "doy_cos")
BOOKINGS = ("reserve_visitors", "reserve_count", LEAD_MEAN)
LEVELS = ("store_mean", "store_median", "store_dow_mean", "store_dow_median")


def feature_order() -> list[str]:
    history = [f"lag_{k}" for k in LAGS]
    for w in ROLL_WINDOWS:
        history += [f"roll_mean_{w}", f"roll_median_{w}"]
    return [
        STORE, DATE, TARGET, "is_closed", *CALENDAR, *HOLIDAY_FLAGS, "golden_week",
        *history, *BOOKINGS, *LEVELS, *METADATA,
    ]


def arrange(df: DataFrame) -> DataFrame:
    """Columns in family order; anything unknown goes last."""
    known = [c for c in feature_order() if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def feature_columns(df: DataFrame) -> list[str]:
    """A model's inputs: every column but the keys and the target."""
    return [c for c in df.columns if c not in (STORE, DATE, TARGET)]


def subset_features(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Keys, target and the named columns, in frame order; ``None`` keeps everything."""
    if names is None:
        return df
    keep = {*names, *KEYS, TARGET}
    return df.select(*[c for c in df.columns if c in keep])


def causal_features(data: PanelData, as_of=None, drop_closed_flag: bool = False, ewm=()) -> DataFrame:
    """Every column that does not depend on a fold: grid, calendar, holidays, history, bookings.

    All windows run on the store placement of the grid, so the whole chain has one exchange
    of the sparse inputs and none of the dense rows. ``ewm`` are rates of exponentially weighted
    means to add.
    """
    daily = None if data.reservations is None else daily_bookings(data.reservations, as_of)
    df = densify(data.visits, daily)
    df = add_history(df)
    if ewm:
        df = add_ewm(df, ewm)
    df = add_holidays(add_calendar(df), data.holidays)
    df = default_bookings(df)
    return df.drop("is_closed") if drop_closed_flag else df


def build_features(
    data: PanelData, reference: DataFrame | None = None, as_of=None, drop_closed_flag: bool = False, ewm=()
) -> DataFrame:
    """The full feature matrix.

    Store levels average the rows of ``reference`` (a training panel: open days only).
    Without one they average the dense grid itself, zeros included.
    """
    df = causal_features(data, as_of, drop_closed_flag, ewm)
    if reference is None:
        reference = densify(data.visits)
    return arrange(add_entities(df, reference.select(*KEYS, F.col(TARGET)), data.stores))
