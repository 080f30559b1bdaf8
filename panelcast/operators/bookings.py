"""Advance-booking columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import lead_time_days
from panelcast.operators.splits import Split, train_rows, valid_rows
from panelcast.schema import DATE, KEYS, STORE

LEAD_MEAN = "reserve_lead_time_mean"


BOOKED = "booked"


def is_daily(reservations: DataFrame) -> bool:
    return "reserve_count" in reservations.columns


def is_cube(reservations: DataFrame) -> bool:
    return BOOKED in reservations.columns


def booking_cube(reservations: DataFrame) -> DataFrame:
    """Bookings summed by store, visit day (``date``) and day of booking (``booked``).

    What was known on any day is a filter and a sum of this table, so many cutoffs share one
    reduction of the single bookings. A cube passes through.
    """
    if is_cube(reservations):
        return reservations
    if is_daily(reservations):
        raise ValueError("a cube needs single bookings; these are already daily")
    day = DATE if DATE in reservations.columns else "visit_date"
    lead = F.col("lead_time_days") if "lead_time_days" in reservations.columns else F.lit(None).cast("double")
    return reservations.groupBy(STORE, F.to_date(day).alias(DATE), F.to_date("reserve_ts").alias(BOOKED)).agg(
        F.sum("reserve_visitors").cast("double").alias("_guests"),
        F.count("*").alias("_n"),
        F.sum(lead).alias("_lead"),
        F.count(lead).alias("_lead_n"),
    )


def _known(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, *KEYS).agg(
        F.sum("_guests").alias("reserve_visitors"),
        F.sum("_n").alias("reserve_count"),
        (F.sum("_lead") / F.nullif(F.sum("_lead_n"), F.lit(0))).alias(LEAD_MEAN),
    )


def known_bookings(cube: DataFrame, splits: list[Split]) -> DataFrame:
    """Daily bookings of each fold's validation days as they stood at the end of its cutoff day.

    Cells are repeated only for the folds whose window holds their visit day, inside the task.
    """
    rows = valid_rows(cube, splits)
    return _known(rows.where(F.col(BOOKED) <= F.col("train_end")), "fold")


def known_at(cube: DataFrame, split: Split) -> DataFrame:
    """Daily bookings of the fold's training days as they stood at the end of its cutoff day."""
    return _known(train_rows(cube, split).where(F.col(BOOKED) <= F.lit(split.train_end)))


def daily_bookings(reservations: DataFrame, as_of=None) -> DataFrame:
    """One row per (store, day): guests, bookings and, when known, mean lead time.

    Input that is already daily passes through, but not with ``as_of``. All aggregates combine on the map side, so
    a store holding a large share of the bookings arrives as one partial row per day and
    task. ``as_of`` keeps only bookings made up to that moment (needs ``reserve_ts``); of a cube,
    those made up to the end of that day.
    """
    if is_cube(reservations):
        kept = reservations if as_of is None else reservations.where(F.col(BOOKED) <= F.to_date(F.lit(as_of)))
        return _known(kept)
    if is_daily(reservations):
        if as_of is not None:
            raise ValueError("as_of needs single bookings; these are already daily")
        return reservations
    rows = reservations
    if as_of is not None:
        rows = rows.where(F.col("reserve_ts") <= as_of)
    day = DATE if DATE in rows.columns else "visit_date"
    aggregates = [
        F.sum("reserve_visitors").cast("double").alias("reserve_visitors"),
        F.count("*").alias("reserve_count"),
    ]
    if "lead_time_days" in rows.columns:
        aggregates.append(F.avg("lead_time_days").alias(LEAD_MEAN))
    return rows.groupBy(STORE, F.to_date(day).alias(DATE)).agg(*aggregates)


_PARTS = ("_guests", "_n", "_lead", "_lead_n")


def _per_day(lines: DataFrame, ids: list[str], as_of=None) -> DataFrame:
    """Partial sums per id and day of raw lines booked up to ``as_of``."""
    if as_of is not None:
        lines = lines.where(F.col("reserve_datetime") <= as_of)
    lead = lead_time_days("visit_datetime", "reserve_datetime")
    return lines.groupBy(*ids, F.to_date("visit_datetime").alias(DATE)).agg(
        F.sum("reserve_visitors").alias("_guests"),
        F.count("*").alias("_n"),
        F.sum(lead).alias("_lead"),
        F.count(lead).alias("_lead_n"),
    )


def _merged(own: DataFrame, foreign: DataFrame, relation: DataFrame, store: str, key: str) -> DataFrame:
    """Daily bookings from partial sums per store (``id``) and per foreign id (``id``)."""
    ids = relation.select(F.col(store).alias(STORE), F.col(key).alias("id"))
    mapped = foreign.join(ids, "id").select(STORE, DATE, *_PARTS)
    return (
        own.select(F.col("id").alias(STORE), DATE, *_PARTS)
        .unionByName(mapped)
        .groupBy(*KEYS)
        .agg(
            F.sum("_guests").cast("double").alias("reserve_visitors"),
            F.sum("_n").alias("reserve_count"),
            (F.sum("_lead") / F.nullif(F.sum("_lead_n"), F.lit(0))).alias(LEAD_MEAN),
        )
    )


def daily_bookings_mixed(
    lines: DataFrame,
    relation: DataFrame,
    store: str = STORE,
    foreign: str = "hpg_store_id",
    as_of=None,
) -> DataFrame:
    """Daily bookings straight from raw lines (``id``, ``is_foreign``, two times, guests).

    Lines are first reduced to one row per (id, day); only then are foreign ids mapped and the
    two kinds merged. An id with a huge share of the bookings therefore reaches the mapping join
    as one row per day. Equal to ``daily_bookings`` of the row-level union. ``as_of`` keeps only
    lines booked up to that moment.
    """
    per_day = _per_day(lines, ["is_foreign", "id"], as_of)
    return _merged(per_day.where(~F.col("is_foreign")), per_day.where("is_foreign"), relation, store, foreign)


def daily_bookings_from(
    direct: DataFrame,
    mapped: DataFrame,
    relation: DataFrame,
    store: str = STORE,
    foreign: str = "hpg_store_id",
    as_of=None,
) -> DataFrame:
    """The same from two sources, one with its own and one with foreign ids, of any two types."""
    own = _per_day(direct.withColumnRenamed(store, "id"), ["id"], as_of)
    other = _per_day(mapped.withColumnRenamed(foreign, "id"), ["id"], as_of)
    return _merged(own, other, relation, store, foreign)


def default_bookings(df: DataFrame) -> DataFrame:
    """Absent bookings count as zero; missing columns are added (lead time only if known)."""
    filled = {}
    for name, kind in (("reserve_visitors", "double"), ("reserve_count", "bigint")):
        value = F.col(name) if name in df.columns else F.lit(None)
        filled[name] = F.coalesce(value.cast(kind), F.lit(0).cast(kind))
    if LEAD_MEAN in df.columns:
        filled[LEAD_MEAN] = F.coalesce(F.col(LEAD_MEAN), F.lit(0.0))
    return df.withColumns(filled)


def add_bookings(df: DataFrame, reservations: DataFrame | None, as_of=None) -> DataFrame:
    """Left join of the daily bookings onto any (store, date) frame."""
    if reservations is not None:
        df = df.join(daily_bookings(reservations, as_of), list(KEYS), "left")
    return default_bookings(df)
