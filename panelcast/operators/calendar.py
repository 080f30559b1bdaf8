"""Calendar and holiday columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import scalar
from panelcast.schema import DATE

HOLIDAY_FLAGS = ("is_holiday", "day_before_holiday", "day_after_holiday")


def add_calendar(df: DataFrame) -> DataFrame:
    d = F.col(DATE)
    angle = scalar.year_angle(d)
    return df.withColumns(
        {
            "dow": scalar.day_of_week(d),
            "is_weekend": (scalar.day_of_week(d) >= 5).cast("int"),
            "month": F.month(d),
            "day_of_month": F.dayofmonth(d),
            "doy_sin": F.sin(angle),
            "doy_cos": F.cos(angle),
        }
    )


def holiday_neighbours(holidays: DataFrame) -> DataFrame:
    """One row per calendar day, with flags for the row before and after a holiday.

    Neighbours are rows of the calendar table, not calendar days. Reduced to one row per
    day first, the table is bounded by the length of the calendar whatever its source, so
    it may be ordered whole here and broadcast below.
    """
    w = Window.orderBy(DATE)
    flag = F.col("is_holiday")
    days = holidays.groupBy(DATE).agg(F.max(F.col("is_holiday").cast("int")).alias("is_holiday"))
    return days.select(
        DATE,
        flag,
        F.coalesce(F.lead(flag, 1).over(w), F.lit(0)).alias("day_before_holiday"),
        F.coalesce(F.lag(flag, 1).over(w), F.lit(0)).alias("day_after_holiday"),
    )


def add_holidays(df: DataFrame, holidays: DataFrame | None = None, golden_week=scalar.GOLDEN_WEEK):
    """Holiday flags by date (0 when absent) plus the Golden Week flag.

    The calendar is broadcast: it holds one row per day (see ``holiday_neighbours``), and
    joining it by shuffle would move the grid to its dates and back to its stores.
    """
    if holidays is None:
        df = df.withColumns({c: F.lit(0) for c in HOLIDAY_FLAGS})
    else:
        df = df.join(F.broadcast(holiday_neighbours(holidays)), DATE, "left").withColumns(
            {c: F.coalesce(F.col(c), F.lit(0)) for c in HOLIDAY_FLAGS}
        )
    return df.withColumn("golden_week", scalar.in_month_day_range(F.col(DATE), *golden_week))
