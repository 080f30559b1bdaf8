"""Block forecasters: the whole horizon from one trailing series, with ten quantiles."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import clip_nonneg
from panelcast.models.base import Forecaster
from panelcast.operators.panel import future_scaffold
from panelcast.plans.windows import context_windows
from panelcast.schema import DATE, STORE, TARGET

N_QUANTILES = 10


class BlockForecaster(ABC):
    """Contract: windows (any keys plus ``ys``) in, one row per key and step out.

    The output holds the keys, ``step`` (1..horizon), ``point`` and ``quantiles`` (ten).
    """

    version = "v1"

    @abstractmethod
    def forecast(self, windows: DataFrame, horizon: int) -> DataFrame: ...


class WeekdayProfile(BlockForecaster):
    """Built in: mean and deciles of the window's values on the target's weekday.

    Works on the trailing array alone, so it is a projection: no exchange, no Python. A
    weekday the window never saw uses all of its values. Quantile 0 is the mean.
    """

    version = "weekday-v1"

    def forecast(self, windows: DataFrame, horizon: int) -> DataFrame:
        keys = [c for c in windows.columns if c != "ys"]
        ys, n = F.col("ys"), F.size("ys")

        def on_phase(phase):
            # Every seventh value from the end by its place, not by testing each value seven times.
            own = F.sequence(F.greatest(n - phase, F.lit(1)), F.lit(1), F.lit(-7))
            return F.when(n > phase, own).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))

        places = F.array(*[on_phase(p) for p in range(7)])
        placed = windows.select(*keys, "ys", places.alias("_places"))
        # Two columns, so that a plan that reads the points alone neither sorts nor takes deciles.
        mean = F.transform("_places", lambda at: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(ys, i - 1)) / F.size(at))
        ordered = F.transform("_places", lambda at: F.sort_array(F.transform(at, lambda i: F.get(ys, i - 1))))
        means = placed.select(*keys, mean.alias("_means"), ordered.alias("_ordered"))
        profiled = means.select(*keys, "_means", F.zip_with("_means", "_ordered", _quantiles).alias("_quantiles"))
        # Step k falls on the weekday of the window day that lies -k (mod 7) from its end.
        steps = profiled.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        own = F.pmod(-F.col("step"), F.lit(7)) + 1
        return steps.select(
            *keys, "step", F.element_at("_means", own).alias("point"), F.element_at("_quantiles", own).alias("quantiles")
        )


def _quantiles(mean: Column, ordered: Column) -> Column:
    """The mean and nine deciles of an ascending array."""
    n = F.size(ordered)

    def decile(d):
        rank = (n - 1) * F.lit(d / 10.0)
        low = F.floor(rank).cast("int")
        below = F.element_at(ordered, low + 1)
        above = F.element_at(ordered, F.ceil(rank).cast("int") + 1)
        return below + (above - below) * (rank - low)

    return F.array(mean, *[decile(d) for d in range(1, 10)])


class PandasBlock(BlockForecaster):
    """A user's own forecaster: ``fn(list of 1-D arrays, horizon) -> (n x h, n x h x 10)``.

    Called once per Arrow batch with all of its series; Spark spreads the batches.
    """

    def __init__(
        self,
        fn: Callable[[list[np.ndarray], int], tuple[np.ndarray, np.ndarray]],
        version: str = "user-v1",
    ) -> None:
        self.fn = fn
        self.version = version

    def forecast(self, windows: DataFrame, horizon: int) -> DataFrame:
        keys = [f for f in windows.schema.fields if f.name != "ys"]
        schema = T.StructType(
            [
                *keys,
                T.StructField("step", T.IntegerType()),
                T.StructField("point", T.DoubleType()),
                T.StructField("quantiles", T.ArrayType(T.DoubleType())),
            ]
        )
        fn, names = self.fn, [f.name for f in keys]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                series = [np.asarray(v, dtype=float) for v in batch["ys"]]
                point, quant = fn(series, horizon)
                out = batch[names].loc[batch.index.repeat(horizon)].reset_index(drop=True)
                out["step"] = np.tile(np.arange(1, horizon + 1, dtype="int32"), len(batch))
                out["point"] = np.asarray(point, dtype=float).reshape(-1)
                flat = np.asarray(quant, dtype=float).reshape(len(out), -1)
                out["quantiles"] = list(flat)
                yield out

        return windows.mapInPandas(run, schema)


class BlockModel(Forecaster):
    """Uses a block forecaster as a model of its own; nothing is trained."""

    name = "window_profile"
    recursive = False

    def __init__(self, forecaster: BlockForecaster | None = None, params: dict | None = None):
        self.forecaster = forecaster or WeekdayProfile()
        self.max_context = int((params or {}).get("max_context", 512))
        self.global_mean = 0.0

    def fit(self, train: DataFrame) -> BlockModel:
        self.global_mean = float(train.agg(F.avg(TARGET)).first()[0] or 0.0)
        return self

    def forecast_block(self, history: DataFrame, cutoff, horizon: int) -> DataFrame:
        windows = context_windows(history, [(0, cutoff)], self.max_context).drop("origin")
        block = self.forecaster.forecast(windows.drop("cutoff"), horizon)
        known = block.select(STORE, F.date_add(F.lit(cutoff), F.col("step")).alias(DATE), "point")
        wanted = future_scaffold(history, cutoff, horizon).drop(TARGET)
        value = F.coalesce(F.col("point"), F.lit(self.global_mean))
        return wanted.join(known, [STORE, DATE], "left").select(
            STORE, DATE, clip_nonneg(value).alias("y_pred")
        )

    def forecast_folds(self, visits: DataFrame, splits, horizon: int) -> DataFrame:
        return block_rollout(visits, splits, horizon, self.forecaster, self.max_context)

    def predict(self, features: DataFrame) -> DataFrame:
        raise NotImplementedError("a block model forecasts from history; see forecast_block")

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        spark.createDataFrame(
            [(self.global_mean, self.max_context)], "global_mean double, max_context int"
        ).write.mode("overwrite").json(path)

    def load(self, spark, path: str) -> BlockModel:
        row = spark.read.schema("global_mean double, max_context int").json(path).first()
        self.global_mean, self.max_context = row[0], row[1]
        return self


def block_rollout(
    visits: DataFrame, splits, horizon: int, forecaster: BlockForecaster, max_context: int
) -> DataFrame:
    """Every fold's block forecast at once: fold, store_id, date, horizon_offset, y_pred."""
    origins = [(s.fold, s.train_end) for s in splits]
    windows = context_windows(visits, origins, max_context)
    return forecaster.forecast(windows, horizon).select(
        F.col("origin").alias("fold"),
        STORE,
        F.date_add("cutoff", F.col("step")).alias(DATE),
        F.col("step").alias("horizon_offset"),
        clip_nonneg(F.col("point")).alias("y_pred"),
    )
