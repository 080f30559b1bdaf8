"""Row-level column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Northern-hemisphere meteorological seasons by month.
SEASONS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}

# The Golden Week cluster as (first month, first day), (last month, last day).
GOLDEN_WEEK = ((4, 29), (5, 5))

# Fixed value: mean length of the year used by the day-of-year circle.
YEAR_DAYS = 365.25


def lead_time_days(visit_ts, reserve_ts) -> Column:
    """Fractional days between booking and visit; negative when booked afterwards."""
    gap = F.unix_micros(F.col(visit_ts).cast("timestamp")) - F.unix_micros(
        F.col(reserve_ts).cast("timestamp")
    )
    return gap / F.lit(86_400_000_000.0)


def day_of_week(date) -> Column:
    """Monday 0 ... Sunday 6."""
    return F.weekday(date)


def year_angle(date) -> Column:
    return F.dayofyear(date) * F.lit(2.0) * F.pi() / F.lit(YEAR_DAYS)


def in_month_day_range(date, first=GOLDEN_WEEK[0], last=GOLDEN_WEEK[1]) -> Column:
    """1 when the date's month/day lies between the two (month, day) pairs, same year."""
    ordinal = F.month(date) * 100 + F.dayofmonth(date)
    lo, hi = (m * 100 + d for m, d in (first, last))
    return ordinal.between(lo, hi).cast("int")


def season(date) -> Column:
    month = F.month(date)
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def area_part(area, position: int) -> Column:
    """The ``position``-th (from 1) of at most three space-separated parts, else null."""
    return F.try_element_at(F.split(area, " ", 3), F.lit(position))


def region(area) -> Column:
    """First token of the address on any whitespace; null when there is none."""
    return F.nullif(F.regexp_extract(area, r"^\s*(\S+)", 1), F.lit(""))


def clip_nonneg(y) -> Column:
    """Floor at zero, null stays null (``greatest`` alone would turn null into 0)."""
    y = F.col(y) if isinstance(y, str) else y
    return F.when(y < 0, F.lit(0.0)).otherwise(y)


def to_log(y) -> Column:
    return F.log1p(y)


def from_log(y) -> Column:
    return clip_nonneg(F.expm1(y))


def last_values(values, n: int) -> Column:
    """The last ``n`` elements of an array, or all of a shorter one."""
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def series_key(values, horizon: int, context: int, version: str = "v1") -> Column:
    """Content key of a forecast request: same trimmed series and horizon, same key."""
    body = F.concat_ws(",", F.transform(values, lambda v: v.cast("string")))
    head = F.lit(f"{version}|{horizon}|{context}|")
    return F.sha2(F.concat(head, body), 256)
