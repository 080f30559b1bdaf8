"""Seasonal naive: the same weekday a week earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import clip_nonneg, day_of_week
from panelcast.models.base import Forecaster
from panelcast.operators.splits import Split, fold_levels, trailing_rows
from panelcast.schema import DATE, STORE, TARGET, TRIM_DAYS
from panelcast.session import stage

SEASON = 7


class SeasonalNaive(Forecaster):
    """``lag_7``, else the store's weekday mean, else the global mean of the training frame."""

    name = "seasonal_naive"

    def __init__(self, params: dict | None = None) -> None:
        self.global_mean = 0.0

    def fit(self, train: DataFrame) -> SeasonalNaive:
        self.global_mean = float(train.agg(F.avg(TARGET)).first()[0] or 0.0)
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        return features.withColumn("y_pred", naive_value(features.columns, F.lit(self.global_mean)))

    def forecast_folds(self, visits: DataFrame, splits: list[Split], horizon: int) -> DataFrame:
        return naive_rollout(visits, splits, horizon)

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.global_mean,)], "global_mean double").write.mode(
            "overwrite"
        ).json(path)

    def load(self, spark, path: str) -> SeasonalNaive:
        self.global_mean = spark.read.schema("global_mean double").json(path).first()[0]
        return self


def naive_value(columns, global_mean: Column) -> Column:
    sources = [F.col(c) for c in ("lag_7", "store_dow_mean") if c in columns]
    return clip_nonneg(F.coalesce(*sources, global_mean))


def naive_rollout(visits: DataFrame, splits: list[Split], horizon: int) -> DataFrame:
    """The recursive forecast of every fold and store in closed form.

    Day +k repeats the last week's day of the same weekday, because each prediction feeds
    the one a week later; where that day is unknown its fallback repeats the same way. So
    one aggregation per (fold, store) replaces the day loop: seven trailing values on the
    zero-filled grid (which starts at the first observation inside the trimmed history).

    Returns fold, store_id, date, horizon_offset, y_pred.
    """
    recent = trailing_rows(visits, splits, TRIM_DAYS)
    back = F.datediff("train_end", DATE)
    week = recent.groupBy("fold", STORE).agg(
        F.min(DATE).alias("recent_first"),
        F.array(
            *[F.max(F.when(back == j, F.col(TARGET))) for j in range(SEASON)]
        ).alias("back_values"),
    )
    # A table, as the levels are read twice and are two exchanges of the whole history.
    profiles = stage(fold_levels(visits, splits), "levels")
    # The global fallback averages the dense grid: all targets over all span days.
    span = F.datediff("last_day", "first_day") + 1
    means = profiles.groupBy("fold").agg((F.sum("total") / F.sum(span)).alias("global_mean"))
    ends = F.create_map(*[x for s in splits for x in (F.lit(s.fold), F.lit(s.train_end))])
    # One row per fold: a proven size, so sending it to every task is safe.
    state = (
        profiles.select("fold", STORE, "_dow_mean")
        .join(week, ["fold", STORE], "left")
        .join(F.broadcast(means), "fold")
        .withColumn("train_end", F.element_at(ends, F.col("fold")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    )
    j = F.lit(SEASON - 1) - (F.col("step") - 1) % SEASON
    day = F.date_add("train_end", F.col("step"))
    source_day = F.date_sub("train_end", j)
    value = F.coalesce(
        F.element_at("back_values", j + 1),
        F.when(source_day >= F.col("recent_first"), F.lit(0.0)),
        F.element_at("_dow_mean", day_of_week(day) + 1),
        F.col("global_mean"),
    )
    return state.select(
        "fold", STORE, day.alias(DATE), F.col("step").alias("horizon_offset"),
        clip_nonneg(value).alias("y_pred"),
    )
