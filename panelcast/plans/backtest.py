"""Rolling-origin backtests over a staged feature frame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.base import Forecaster, merge_rows
from panelcast.models.naive import naive_rollout
from panelcast.models.window import block_rollout
from panelcast.operators.bookings import add_bookings, booking_cube, daily_bookings, is_cube, is_daily, known_at
from panelcast.operators.entities import METADATA, pick_weekday, store_metadata
from panelcast.operators.splits import Split, fold_profiles, last_days, train_rows, valid_rows
from panelcast.plans.features import LEVELS, arrange, causal_features, feature_columns, subset_features
from panelcast.plans.rollout import rollout
from panelcast.schema import DATE, KEYS, STORE, TARGET, PanelData
from panelcast.session import stage


@dataclass(frozen=True)
class ModelSpec:
    """A candidate: how to build it, its first configuration and its grid."""

    name: str
    factory: Callable[[dict], Forecaster]
    default: dict = field(default_factory=dict)
    grid: list[dict] = field(default_factory=lambda: [{}])
    is_tree: bool = False


def score_alignment(preds: DataFrame, visits: DataFrame, splits: list[Split]) -> DataFrame:
    """Predictions met with the observed days only; closed days are never scored."""
    observed = valid_rows(visits.select(STORE, DATE, TARGET), splits).select(
        "fold",
        STORE,
        DATE,
        F.col(TARGET).alias("y_true"),
        F.datediff(DATE, "train_end").alias("horizon_offset"),
    )
    guesses = preds.select("fold", STORE, DATE, "y_pred")
    return observed.join(guesses, ["fold", STORE, DATE], "inner").select(
        "fold", STORE, DATE, "y_pred", "y_true", "horizon_offset"
    )


def backtest_naive(visits: DataFrame, splits: list[Split], horizon: int) -> DataFrame:
    return score_alignment(naive_rollout(visits, splits, horizon), visits, splits)


def backtest_block(visits, splits, horizon, forecaster, max_context: int) -> DataFrame:
    preds = block_rollout(visits, splits, horizon, forecaster, max_context)
    return score_alignment(preds, visits, splits)


def prepare(data: PanelData, as_of: bool = False) -> PanelData:
    """Bookings reduced once, to days or, if they are to be read at cutoffs, to days by booking day;
    every later use passes them through."""
    if data.reservations is None or is_cube(data.reservations):
        return data
    if as_of:
        return replace(data, reservations=stage(booking_cube(data.reservations), "booking-cube"))
    if is_daily(data.reservations):
        return data
    return replace(data, reservations=stage(daily_bookings(data.reservations), "bookings"))


class Backtest:
    """Scores models over folds that share one featurised frame.

    Grid, calendar, holiday, history and booking columns are causal, so they are computed
    once for all folds. A fold only filters that frame and joins its own store levels. With
    ``bookings_as_of``, a fold also reads the booking columns as they stood at its cutoff.
    """

    def __init__(
        self, data: PanelData, splits: list[Split], horizon: int, parallel: int = 2, bookings_as_of: bool = False
    ):
        self.bookings_as_of = bookings_as_of and data.reservations is not None
        self.data = prepare(data, self.bookings_as_of)
        self.splits = splits
        self.horizon = horizon
        self.parallel = parallel
        self._features: DataFrame | None = None
        self._narrow: dict[tuple, DataFrame] = {}
        self._profiles: DataFrame | None = None

    @property
    def features(self) -> DataFrame:
        if self._features is None:
            self._features = stage(self._causal(), "features")
        return self._features

    def _causal(self) -> DataFrame:
        last = max(s.train_end for s in self.splits)
        return causal_features(replace(self.data, visits=self.data.visits.where(F.col(DATE) <= F.lit(last))))

    def frame(self, selected: list[str] | None = None) -> DataFrame:
        """The shared frame; while it isn't staged as a whole, only what the selected columns need is."""
        if selected is None or self._features is not None:
            return self.features
        key = tuple(sorted(selected))
        if key not in self._narrow:
            # The weekday picks a store's levels.
            self._narrow[key] = stage(subset_features(self._causal(), [*selected, "dow"]), "features")
        return self._narrow[key]

    @property
    def profiles(self) -> DataFrame:
        if self._profiles is None:
            self._profiles = stage(fold_profiles(self.data.visits, self.splits), "profiles")
        return self._profiles

    def fold_features(self, split: Split, selected: list[str] | None = None) -> DataFrame:
        """What featurising the fold's training slice alone would give, or the selected columns of it.

        Rows after a store's last observed training day are dropped: the grid of the slice
        would have ended there. That day also bounds the slice, so the frame needs no other filter and
        folds read in one plan share one exchange of it where the planner needs one.
        """
        levels = self.profiles.where(F.col("fold") == split.fold).select(
            STORE, "last_day", "store_mean", "store_median", "_dow_mean", "_dow_median"
        )
        if self.data.stores is not None:
            levels = levels.join(store_metadata(self.data.stores), STORE, "left")
        rows = self.frame(selected).join(levels, STORE)
        if self.bookings_as_of:
            known = known_at(self.data.reservations, split)
            rows = add_bookings(rows.drop(*[c for c in known.columns if c not in KEYS]), known)
        whole = arrange(pick_weekday(rows.where(F.col(DATE) <= F.col("last_day")).drop("last_day")))
        return subset_features(whole, selected)

    def all_fold_features(self, selected: list[str] | None = None) -> DataFrame:
        """The training frames of all folds, each as ``fold_features`` gives it, with their ``fold``.

        The frame meets one row per store that holds the levels of every fold, once and where the grid
        lies already, and each day is repeated inside the task for the folds that train on it.
        """
        if self.bookings_as_of:
            frames = [self.fold_features(s, selected).withColumn("fold", F.lit(s.fold)) for s in self.splits]
            return reduce(DataFrame.unionByName, frames)
        levels = [c for c in LEVELS if selected is None or c in selected]
        if levels:
            sources = sorted({c.replace("store_dow", "_dow") for c in levels})
            folds = self.profiles.groupBy(STORE).agg(F.collect_list(F.struct("fold", "last_day", *sources)).alias("_folds"))
        else:
            folds = last_days(self.data.visits, self.splits)
        if self.data.stores is not None and (selected is None or set(METADATA) & set(selected)):
            folds = folds.join(store_metadata(self.data.stores), STORE, "left")
        whole = selected is None or self._features is not None
        frame = self.features if whole else subset_features(self._causal(), [*selected, "dow"])
        rows = frame.join(folds, STORE).withColumn("_fold", F.explode("_folds")).where(F.col(DATE) <= F.col("_fold.last_day"))

        def level(c):
            source = F.col("_fold").getField(c.replace("store_dow", "_dow"))
            return F.element_at(source, F.col("dow") + 1) if "_dow_" in c else source

        rows = rows.withColumns({c: level(c) for c in levels}).withColumn("fold", F.col("_fold.fold"))
        keep = None if selected is None else [*selected, "fold"]
        return subset_features(arrange(rows.drop("_folds", "_fold")), keep)

    def _merged(self, selected: list[str]) -> DataFrame:
        """All folds' training rows of the selected columns, equal rows as one with their number."""
        key = ("merged", *sorted(selected))
        if key not in self._narrow:
            rows = self.all_fold_features(selected)
            features = [c for c in feature_columns(rows) if c != "fold"]
            self._narrow[key] = stage(merge_rows(rows, features, "fold"), "training-rows")
        return self._narrow[key]

    def _merges(self, model: Forecaster, selected: list[str] | None) -> bool:
        """Whether all folds' rows are to be merged for the model; selected text is always metadata."""
        if selected is None or self.bookings_as_of:
            return False
        return model.merges({c: "string" if c in METADATA else "double" for c in selected})

    def fold_predictions(
        self, spec: ModelSpec, params: dict, split: Split, selected: list[str] | None
    ) -> DataFrame:
        model = spec.factory(params)
        chosen = selected if spec.is_tree else None
        if self._merges(model, chosen):
            model.fit(self._merged(chosen).where(F.col("fold") == split.fold).drop("fold"))
        else:
            model.fit(self.fold_features(split, chosen))
        history = train_rows(self.data.visits, split)
        data = self.data
        if self.bookings_as_of:
            data = replace(data, reservations=daily_bookings(data.reservations, split.train_end))
        preds = rollout(model, data, history, split.train_end, self.horizon)
        return preds.withColumn("fold", F.lit(split.fold))

    def predictions(
        self, spec: ModelSpec, params: dict | None = None, selected: list[str] | None = None
    ) -> DataFrame:
        """Scored predictions of one configuration over all folds.

        Models with a closed or block form run every fold in a single plan. The others fit
        once per fold; a few folds at a time submit their jobs side by side.
        """
        params = spec.default if params is None else params
        probe = spec.factory(params)
        visits = self.data.visits
        whole = probe.forecast_folds(visits, self.splits, self.horizon)
        if whole is not None:
            return score_alignment(whole, visits, self.splits)
        # Stage what all folds read before the threads start.
        chosen = selected if spec.is_tree else None
        if self._merges(probe, chosen):
            self._merged(chosen)
        else:
            self.frame(chosen), self.profiles

        def one(split):
            return self.fold_predictions(spec, params, split, selected)

        run = inheritable_thread_target(visits.sparkSession)(one)
        with ThreadPoolExecutor(max(1, self.parallel)) as pool:
            jobs = [pool.submit(run, s) for s in self.splits]
            frames = [j.result() for j in jobs]
        preds = reduce(DataFrame.unionByName, frames)
        return score_alignment(preds, visits, self.splits)
