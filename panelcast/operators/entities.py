"""Per-store levels computed from a reference panel, and static store columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalar
from panelcast.schema import DATE, STORE, TARGET

METADATA = ("genre", "area_prefecture", "area_ward")


def weekday_split(value: Column, dow: Column, reducer) -> Column:
    """Seven reduced values, Monday first, as one array: per-weekday levels in a single row."""
    return F.array(*[reducer(F.when(dow == d, value)) for d in range(7)])


def store_profile(reference: DataFrame, *keys: str) -> DataFrame:
    """Mean and median per store and per (store, weekday), one row per store.

    Folding the weekdays into arrays lets one aggregation and one join on the store serve
    all four columns, so the feature grid is never re-shuffled by (store, weekday).
    """
    dow = scalar.day_of_week(F.col(DATE))
    value = F.col(TARGET)
    return reference.groupBy(*(keys or (STORE,))).agg(
        F.avg(value).alias("store_mean"),
        F.median(value).alias("store_median"),
        weekday_split(value, dow, F.avg).alias("_dow_mean"),
        weekday_split(value, dow, F.median).alias("_dow_median"),
    )


def pick_weekday(df: DataFrame) -> DataFrame:
    """Resolve the weekday arrays against the row's ``dow``."""
    at = F.col("dow") + 1
    return df.withColumns(
        {
            "store_dow_mean": F.element_at("_dow_mean", at),
            "store_dow_median": F.element_at("_dow_median", at),
        }
    ).drop("_dow_mean", "_dow_median")


def store_metadata(stores: DataFrame) -> DataFrame:
    """One row per store with genre and the first two parts of its area.

    Of repeated store rows the smallest (genre, area) wins; taking it by aggregation
    combines duplicates before the exchange.
    """
    known = [c for c in ("genre", "area") if c in stores.columns]
    if not known:
        return stores.select(STORE).distinct()
    one = stores.groupBy(STORE).agg(F.min(F.struct(*known)).alias("_m"))
    columns = []
    if "genre" in known:
        columns.append(F.col("_m.genre").alias("genre"))
    if "area" in known:
        columns += [
            scalar.area_part(F.col("_m.area"), 1).alias("area_prefecture"),
            scalar.area_part(F.col("_m.area"), 2).alias("area_ward"),
        ]
    return one.select(STORE, *columns)


def add_entities(df: DataFrame, reference: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Store levels from ``reference`` and the static store columns.

    The two store-sized tables are joined to each other first, so the grid meets them once.
    """
    side = store_profile(reference)
    if stores is not None:
        side = side.join(store_metadata(stores), STORE, "left")
    return pick_weekday(df.join(side, STORE, "left"))
