"""Panel-shape operators: gap filling, arrays, scaffolds and coverage.

A canonical panel has one row per (store, day), so one store's series is bounded by the
calendar no matter how many raw rows that store had; it is the unit a window may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.schema import DATE, KEYS, STORE, TARGET


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def last_day(panel: DataFrame):
    """Latest date of the panel, as a driver value (one aggregated row)."""
    return panel.agg(F.max(DATE)).first()[0]


def last_day_column(panel: DataFrame) -> Column:
    """Latest date of the panel as a lazy scalar subquery."""
    return panel.agg(F.max(DATE)).scalar()


def place_by_store(df: DataFrame) -> DataFrame:
    """Hash rows by store into exactly ``spark.sql.shuffle.partitions`` parts.

    The count is fixed on purpose: the work after this exchange (gap filling, windows) is
    several times larger than the shuffled bytes, by which adaptive coalescing would size
    the tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, STORE)


def _sparse_days(visits: DataFrame, daily: DataFrame) -> DataFrame:
    """Visits and daily side rows merged to one row per (store, day), placed by store.

    Both inputs are sparse and already daily, so this single exchange moves far fewer rows
    than joining the side table onto the dense grid would.
    """
    extra = [c for c in daily.columns if c not in KEYS]
    types = dict(daily.dtypes)
    seen = visits.select(
        *KEYS, TARGET, F.lit(1).alias("_seen"), *[F.lit(None).cast(types[c]).alias(c) for c in extra]
    )
    side = daily.select(
        *KEYS, F.lit(None).cast("double").alias(TARGET), F.lit(0).alias("_seen"), *extra
    )
    merged = (
        seen.unionByName(side)
        .transform(place_by_store)
        .groupBy(*KEYS)
        .agg(
            F.max(TARGET).alias(TARGET),
            F.sum("_seen").alias("_seen"),
            *[F.max(c).alias(c) for c in extra],
        )
    )
    whole = Window.partitionBy(STORE)
    seen_day = F.when(F.col("_seen") > 0, F.col(DATE))
    return (
        merged.withColumn("_first", F.min(seen_day).over(whole))
        .withColumn("_last", F.max(seen_day).over(whole))
        .where(F.col(DATE).between(F.col("_first"), F.col("_last")))
    )


def densify(visits: DataFrame, daily: DataFrame | None = None, since=None, until=None) -> DataFrame:
    """Every calendar day of each store's span; absent days get target 0 and ``is_closed`` 1.

    The span runs from the store's first to its last row, or on to ``until`` when given.
    ``since`` drops earlier days without moving the start of the span. ``daily`` is an
    optional (store_id, date, ...) side table whose columns ride along, null where absent.

    Each row is stretched up to the day before the store's next row, so the calendar is
    filled in place: no span table, no join back, one exchange by store.
    """
    rows = visits.select(*KEYS, F.col(TARGET).cast("double").alias(TARGET))
    extra = [] if daily is None else [c for c in daily.columns if c not in KEYS]
    rows = place_by_store(rows) if daily is None else _sparse_days(rows, daily)
    by_day = Window.partitionBy(STORE).orderBy(DATE)
    following = F.lead(DATE).over(by_day)
    end = F.col(DATE) if until is None else F.greatest(F.col(DATE), _as_column(until))
    duplicate = F.raise_error(F.lit("densify needs one row per (store_id, date)"))
    repeated = F.col("_next") == F.col(DATE)
    if daily is not None:
        repeated = repeated | (F.col("_seen") > 1)
    rows = rows.withColumn("_next", following).withColumn(
        "_stop",
        F.when(repeated, duplicate.cast("date")).otherwise(
            F.coalesce(F.date_sub("_next", 1), end)
        ),
    )
    start = F.col(DATE)
    if since is not None:
        rows = rows.where(F.col("_stop") >= _as_column(since))
        start = F.greatest(F.col(DATE), _as_column(since))
    own = F.col("_day") == F.col(DATE)
    return rows.withColumn("_day", F.explode(F.sequence(start, F.col("_stop")))).select(
        STORE,
        F.col("_day").alias(DATE),
        F.when(own & F.col(TARGET).isNotNull(), F.col(TARGET)).otherwise(F.lit(0.0)).alias(TARGET),
        F.when(own & F.col(TARGET).isNotNull(), 0).otherwise(1).alias("is_closed"),
        *[F.when(own, F.col(c)).alias(c) for c in extra],
    )


def densify_to(visits: DataFrame, cutoff=None) -> DataFrame:
    """As ``densify`` but every store runs on to one common cutoff (default: latest day)."""
    cutoff = last_day_column(visits) if cutoff is None else cutoff
    return densify(visits.where(F.col(DATE) <= _as_column(cutoff)), until=cutoff)


def series_arrays(dense: DataFrame, *keys: str) -> DataFrame:
    """One row per series: first day, length and the values in date order.

    The grid is already placed by store, so the arrays are built without another exchange;
    their length is bounded by the calendar span.
    """
    keys = keys or (STORE,)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(DATE).alias("d"), F.col(TARGET).alias("y"))))
    return (
        dense.groupBy(*keys)
        .agg(F.min(DATE).alias("first_day"), pairs.alias("_pairs"))
        .select(*keys, "first_day", F.transform("_pairs", lambda p: p["y"]).alias("ys"))
        .withColumn("n_days", F.size("ys"))
    )


def future_scaffold(stores: DataFrame, cutoff, horizon: int) -> DataFrame:
    """Each store with its next ``horizon`` days after the cutoff, target 0."""
    cutoff = _as_column(cutoff)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return (
        stores.select(STORE)
        .distinct()
        .withColumn("step", F.explode(steps))
        .select(STORE, F.date_add(cutoff, F.col("step")).alias(DATE), F.lit(0.0).alias(TARGET))
    )


def demand_matrix(dense: DataFrame, stores: list) -> DataFrame:
    """Day x store table for the named stores; null outside a store's span.

    A wide export only, with every day from the panel's first to its last, covered by a named
    store or not. Rollouts keep per-store arrays instead.
    """
    wide = dense.groupBy(DATE).pivot(STORE, stores).agg(F.max(TARGET))
    span = dense.agg(F.min(DATE).alias("first"), F.max(DATE).alias("last")).where("first IS NOT NULL")
    days = span.select(F.explode(F.sequence("first", "last")).alias(DATE))
    return days.join(wide, DATE, "left")


def coverage(visits: DataFrame) -> DataFrame:
    """Per store: observed days, calendar days of its span, missing days and their ratio."""
    span = F.datediff("_last", "_first") + 1
    return (
        visits.groupBy(STORE)
        .agg(
            F.count("*").alias("present_days"),
            F.min(DATE).alias("_first"),
            F.max(DATE).alias("_last"),
        )
        .select(
            STORE,
            "present_days",
            span.cast("bigint").alias("span_days"),
            (span - F.col("present_days")).cast("bigint").alias("missing_days"),
            (F.col("present_days") / span).alias("coverage"),
        )
    )
