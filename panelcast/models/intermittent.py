"""Intermittent demand: the size of a demand and the interval to the next, smoothed apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import clip_nonneg
from panelcast.models.base import Forecaster
from panelcast.operators.panel import future_scaffold
from panelcast.operators.splits import Split
from panelcast.schema import DATE, STORE, TARGET

_STATE = "struct<z:double,p:double,last:date,out:array<struct<fold:int,cutoff:date,z:double,p:double>>>"


def demand_states(visits: DataFrame, splits: list[Split], alpha: float, beta: float) -> DataFrame:
    """``fold, cutoff, store_id, z, p``: smoothed demand size and interval up to each cutoff.

    A store's demands (targets above zero) and all cutoffs are one sorted array, folded once: a demand
    updates the state, a cutoff copies it out. Days without demand are never made, since the
    interval is a difference of dates. The first demand sets the size, with an interval of one
    day. Stores without demand up to a cutoff have no row for it. Repeated days count apart.
    """
    last = max(s.train_end for s in splits)
    demand = visits.where((F.col(TARGET) > 0) & (F.col(DATE) <= F.lit(last)))
    event = F.struct(F.col(DATE).alias("day"), F.lit(-1).alias("fold"), F.col(TARGET).cast("double").alias("y"))
    series = demand.groupBy(STORE).agg(F.collect_list(event).alias("events"))
    # Fold labels are not negative, so on equal days a cutoff comes after the demands.
    cutoffs = F.array(
        *[F.struct(F.lit(s.train_end).alias("day"), F.lit(s.fold).alias("fold"), F.lit(0.0).alias("y")) for s in splits]
    )

    def step(state: Column, e: Column) -> Column:
        first = state["last"].isNull()
        size = F.when(first, e["y"]).otherwise(state["z"] + alpha * (e["y"] - state["z"]))
        gap = F.datediff(e["day"], state["last"])
        interval = F.when(first, 1.0).otherwise(state["p"] + beta * (gap - state["p"]))
        seen = F.struct(e["fold"].alias("fold"), e["day"].alias("cutoff"), state["z"].alias("z"), state["p"].alias("p"))
        cut = e["fold"] >= 0
        return F.struct(
            F.when(cut, state["z"]).otherwise(size).alias("z"),
            F.when(cut, state["p"]).otherwise(interval).alias("p"),
            F.when(cut, state["last"]).otherwise(e["day"]).alias("last"),
            F.when(cut & ~first, F.array_append(state["out"], seen)).otherwise(state["out"]).alias("out"),
        )

    begun = F.from_json(F.lit('{"out": []}'), _STATE)
    events = F.array_sort(F.concat("events", cutoffs))
    folded = series.select(STORE, F.aggregate(events, begun, step, lambda s: s["out"]).alias("states"))
    return folded.select(STORE, F.inline("states")).select("fold", "cutoff", STORE, "z", "p")


def demand_rate(beta: float, unbiased: bool) -> Column:
    """Demand per day; ``unbiased`` takes off the bias that a smoothed interval brings."""
    rate = F.col("z") / F.col("p")
    return clip_nonneg(rate * (1.0 - beta / 2.0) if unbiased else rate)


def intermittent_rollout(
    visits: DataFrame, splits: list[Split], horizon: int, alpha: float = 0.1, beta: float = 0.1, unbiased: bool = True
) -> DataFrame:
    """``fold, store_id, date, horizon_offset, y_pred`` of every fold: a flat rate per store."""
    states = demand_states(visits, splits, alpha, beta)
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_offset")
    rows = states.select("fold", STORE, "cutoff", demand_rate(beta, unbiased).alias("y_pred"), step)
    return rows.select("fold", STORE, F.date_add("cutoff", F.col("horizon_offset")).alias(DATE), "horizon_offset", "y_pred")


class IntermittentDemand(Forecaster):
    """A flat forecast from the smoothed size and interval; stores without demand get zero."""

    name = "intermittent"
    recursive = False

    def __init__(self, params: dict | None = None) -> None:
        params = params or {}
        self.alpha = float(params.get("alpha", 0.1))
        self.beta = float(params.get("beta", self.alpha))
        self.unbiased = bool(params.get("unbiased", True))

    def fit(self, train: DataFrame) -> IntermittentDemand:
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        raise NotImplementedError("forecasts blocks from the history alone")

    def forecast_block(self, history: DataFrame, cutoff, horizon: int) -> DataFrame:
        one = [Split(0, cutoff, cutoff, cutoff)]
        found = self.forecast_folds(history, one, horizon).select(STORE, DATE, "y_pred")
        every = future_scaffold(history, cutoff, horizon).drop(TARGET)
        return every.join(found, [STORE, DATE], "left").na.fill(0.0, ["y_pred"])

    def forecast_folds(self, visits: DataFrame, splits: list[Split], horizon: int) -> DataFrame:
        return intermittent_rollout(visits, splits, horizon, self.alpha, self.beta, self.unbiased)

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        rows = [(self.alpha, self.beta, self.unbiased)]
        frame = SparkSession.getActiveSession().createDataFrame(rows, "alpha double, beta double, unbiased boolean")
        frame.write.mode("overwrite").json(path)

    def load(self, spark, path: str) -> IntermittentDemand:
        row = spark.read.schema("alpha double, beta double, unbiased boolean").json(path).first()
        self.alpha, self.beta, self.unbiased = row
        return self
