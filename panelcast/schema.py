"""Names, input shapes and run settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

STORE = "store_id"
DATE = "date"
TARGET = "visitors"
KEYS = (STORE, DATE)

# The lags and rolling widths (in days) of the feature set.
LAGS = (1, 7, 14, 21, 28, 35)
ROLL_WINDOWS = (7, 14, 28, 35)

# A rollout looks at this many days of actuals before its cutoff.
TRIM_DAYS = max(LAGS) + max(ROLL_WINDOWS) + 10

# Longest history any lag or rolling column needs.
DEPTH = max(max(LAGS), max(ROLL_WINDOWS))


@dataclass(frozen=True)
class PanelData:
    """The four canonical inputs, all lazy.

    visits        store_id, date, visitors               one row per observed store day
    reservations  store_id, visit_date, reserve_visitors[, lead_time_days, reserve_ts]
                  one row per booking, or already daily (see ``operators.bookings``)
    stores        store_id[, genre, area, lat, lon]
    holidays      date, is_holiday
    """

    visits: DataFrame
    reservations: DataFrame | None = None
    stores: DataFrame | None = None
    holidays: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    """Run settings; the defaults are fixed values of the forecasting task."""

    horizon_days: int = 14
    final_horizon_days: int = 39
    cv_window_days: int = 365
    cv_stride_days: int = 9
    selection_metric: str = "rmsle"
    feature_select_threshold: float = 0.98
    under_weight: float = 2.0
    over_weight: float = 1.0
    max_context: int = 512
    train_origins: int = 60
    #: Whether backtests see only the bookings known at each fold's cutoff.
    bookings_as_of: bool = False

    @property
    def n_folds(self) -> int:
        return self.cv_window_days // self.cv_stride_days
