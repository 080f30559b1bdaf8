"""Outlier capping: targets limited to exact quantiles of their own store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.schema import STORE, TARGET


def store_caps(reference: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """``store_id, cap_low, cap_high``: interpolated quantiles of every store's targets.

    All stores' quantiles come from one aggregation. It combines equal targets before the
    exchange, and a store holds at most one target per day, so no group outgrows the calendar.
    """
    both = F.percentile(F.col(TARGET).cast("double"), F.array(F.lit(lower), F.lit(upper)))
    caps = reference.groupBy(STORE).agg(both.alias("caps"))
    return caps.select(STORE, F.col("caps")[0].alias("cap_low"), F.col("caps")[1].alias("cap_high"))


def cap_outliers(panel: DataFrame, reference: DataFrame | None = None, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """The panel with capped targets, and ``is_capped``. ``reference`` is what the quantiles come
    from, such as a fold's training slice; stores that it lacks stay as they are."""
    caps = store_caps(panel if reference is None else reference, lower, upper)
    value = F.col(TARGET).cast("double")
    capped = F.coalesce(F.least(F.greatest(value, F.col("cap_low")), F.col("cap_high")), value)
    joined = panel.join(caps, STORE, "left").withColumn("_capped", F.when(value.isNotNull(), capped))
    kept = [F.col("_capped").alias(TARGET) if c == TARGET else F.col(c) for c in panel.columns]
    changed = F.coalesce((F.col("_capped") != value).cast("int"), F.lit(0)).alias("is_capped")
    return joined.select(*kept, changed)
