"""What a forecasting model offers to backtests and rollouts."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.history import history_columns
from panelcast.schema import STORE, TARGET

#: How many equal rows a merged row stands for.
WEIGHT = "_weight"


def merge_rows(train: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Rows with equal features and target as one row with their number; merged rows merge further."""
    number = F.sum(WEIGHT) if WEIGHT in train.columns else F.count("*").cast("double")
    return train.groupBy(*keys, *features, TARGET).agg(number.alias(WEIGHT))


class Forecaster(ABC):
    """A model over feature frames; every method takes and returns DataFrames.

    ``recursive`` models are rolled forward day by day on their own predictions. The others
    implement ``forecast_block`` and give the whole horizon at once.
    """

    name = "forecaster"
    recursive = True
    is_tree = False
    #: Rates of the exponentially weighted means that a rollout carries on for the model.
    smoothing: tuple[float, ...] = ()

    @abstractmethod
    def fit(self, train: DataFrame) -> Forecaster:
        """Learn from a feature frame; returns the model itself."""

    @abstractmethod
    def predict(self, features: DataFrame) -> DataFrame:
        """The frame plus a non-negative ``y_pred``."""

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def load(self, spark, path: str) -> Forecaster: ...

    def merges(self, kinds: dict[str, str]) -> bool:
        """Whether ``fit`` learns the same from equal rows as from one of them with their number in
        ``WEIGHT``, and it pays to merge them; ``kinds`` are the features and their types."""
        return False

    def augment(self, scaffold: DataFrame, history: DataFrame, cutoff, horizon: int) -> DataFrame:
        """Add columns to the future rows (store_id, date, step), once per rollout."""
        return scaffold

    def pack_future(self, future: DataFrame) -> DataFrame:
        """One column ``static`` per future row with all the model needs of that day.

        By default every column as a struct; a model may keep something more compact.
        """
        known = [c for c in future.columns if c not in (STORE, "step")]
        return future.select(STORE, "step", F.struct(*known).alias("static"))

    def step(self, rows: DataFrame, static: Column, hist: Column) -> DataFrame:
        """The frame plus ``y_pred`` for one day, from its static part and trailing values; the rows
        also hold a column for each rate of ``smoothing``."""
        given = rows.columns
        wide = rows.select(
            "*",
            static.alias("_today"),
            *[c.alias(name) for name, c in history_columns(hist).items()],
        )
        wide = wide.select("*", "_today.*").drop("_today")
        return self.predict(wide).select(*given, "y_pred")

    def forecast_folds(self, visits: DataFrame, splits, horizon: int) -> DataFrame | None:
        """All folds' forecasts (fold, store_id, date, y_pred) in one plan, for models that have such a
        form; None for those that are fitted and rolled out fold by fold."""
        return None

    def forecast_block(self, history: DataFrame, cutoff, horizon: int) -> DataFrame:
        """All future rows (store_id, date, y_pred) in one go."""
        raise NotImplementedError(f"{self.name} forecasts step by step")


class ImportanceForecaster(Forecaster):
    """A model that can say how much each feature contributed."""

    is_tree = True

    @abstractmethod
    def feature_importance(self) -> DataFrame:
        """One row per feature: ``feature, value``."""
