"""Trailing windows per (origin, store), the input of block forecasters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.panel import densify, series_arrays
from panelcast.schema import DATE, STORE


def context_windows(visits: DataFrame, origins: list[tuple[int, date]], max_context: int):
    """``origin, cutoff, store_id, ys``: the gap-free series up to each cutoff, trimmed.

    A store's days are gathered once and each origin is a slice of that array, so many
    origins cost no exchange. An array holds at most ``max_context`` days plus the distance
    between the first and last origin. Stores not yet open at a cutoff have no row for it.
    """
    first, last = min(c for _, c in origins), max(c for _, c in origins)
    since = first - timedelta(days=max_context - 1)
    dense = densify(visits.where(F.col(DATE) <= F.lit(last)), since=since, until=last)
    labels = F.array(
        *[F.struct(F.lit(o).alias("origin"), F.lit(c).alias("cutoff")) for o, c in origins]
    )
    end = F.datediff("cutoff", "first_day") + 1
    start = F.greatest(end - max_context + 1, F.lit(1))
    return (
        series_arrays(dense)
        .select(STORE, "first_day", F.col("ys").alias("_all"), F.inline(labels))
        .where(end >= 1)
        .select("origin", "cutoff", STORE, F.slice("_all", start, end - start + 1).alias("ys"))
    )
