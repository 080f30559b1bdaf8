"""Every operator as a query over the parquet tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import session
from panelcast.functions import scalar
from panelcast.models.hybrid import FusedTrees
from panelcast.models.naive import naive_rollout, naive_value
from panelcast.models.trees import BoostedTrees
from panelcast.models.window import WeekdayProfile, block_rollout
from panelcast.operators import panel, profile, quantiles, ranking, report, splits
from panelcast.operators.bookings import add_bookings, daily_bookings
from panelcast.operators.calendar import HOLIDAY_FLAGS, add_calendar, add_holidays
from panelcast.operators.entities import pick_weekday, store_metadata, store_profile
from panelcast.operators.history import add_history, observed_history
from panelcast.plans import backtest, deploy, rollout, selection, signals
from panelcast.plans.features import (
    BOOKINGS,
    CALENDAR,
    LEVELS,
    build_features,
    subset_features,
)
from panelcast.plans.windows import context_windows
from panelcast.schema import DATE, KEYS, LAGS, ROLL_WINDOWS, STORE, TARGET, PanelData, Settings
from panelcast.sources import bindings

SETTINGS = Settings()
HORIZON = SETTINGS.horizon_days
WEIGHTS = {"under_weight": SETTINGS.under_weight, "over_weight": SETTINGS.over_weight}
CONTEXT_GRID = (512, 112, 56)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded doubles, so both engines agree past the last bits of a float sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- scans ---------------------------------------------------------------------------------


@query
def visits_scan(spark, d):
    return bindings.visits(spark, d)


@query
def reservations_union(spark, d):
    rows = bindings.reservations(spark, d).drop("reserve_ts")
    return r6(rows, "lead_time_days")


@query
def stores_scan(spark, d):
    return bindings.stores(spark, d)


@query
def holidays_scan(spark, d):
    """The calendar: every day of the panel's span and the weeks after it."""
    return bindings.holidays(spark, d)


# --- panel shape ---------------------------------------------------------------------------


@query
def densify(spark, d):
    return panel.densify(bindings.visits(spark, d))


@query
def densify_to_cutoff(spark, d):
    return panel.densify_to(bindings.visits(spark, d))


def _joined(values):
    return F.concat_ws(",", F.transform(values, lambda v: v.cast("bigint").cast("string")))


@query
def series_arrays(spark, d):
    arrays = panel.series_arrays(panel.densify(bindings.visits(spark, d)))
    return arrays.withColumn("ys", _joined(F.col("ys")))


@query
def future_scaffold(spark, d):
    visits = bindings.visits(spark, d)
    return panel.future_scaffold(visits, panel.last_day_column(visits), HORIZON)


@query
def demand_matrix(spark, d):
    visits = bindings.nation_orders(spark, d)
    keys = bindings.table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey")
    wide = panel.demand_matrix(panel.densify(visits), [r[0] for r in keys.collect()])
    return wide.select(DATE, *[F.col(c).alias(f"s{c}") for c in wide.columns if c != DATE])


@query
def coverage(spark, d):
    return r6(panel.coverage(bindings.visits(spark, d)), "coverage")


@query
def coverage_histogram(spark, d):
    cov = panel.coverage(bindings.visits(spark, d))
    return r6(quantiles.histogram(cov, "coverage", 40), "left_edge")


# --- features ------------------------------------------------------------------------------


@query
def calendar_features(spark, d):
    df = add_calendar(bindings.visits(spark, d))
    return r6(df.select(*KEYS, *CALENDAR), "doy_sin", "doy_cos", digits=9)


@query
def holiday_features(spark, d):
    df = add_holidays(bindings.visits(spark, d), bindings.holidays(spark, d))
    return df.select(
        *KEYS, "is_holiday", "day_before_holiday", "day_after_holiday", "golden_week"
    )


@query
def lag_features(spark, d):
    df = add_history(panel.densify(bindings.visits(spark, d)))
    return df.select(*KEYS, *[f"lag_{k}" for k in LAGS])


@query
def rolling_features(spark, d):
    df = add_history(panel.densify(bindings.visits(spark, d)))
    names = [f"roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("mean", "median")]
    return r6(df.select(*KEYS, *names), *names)


@query
def lag_observed(spark, d):
    return r6(observed_history(bindings.visits(spark, d)), "roll_7_mean", "store_mean")


@query
def reservations_daily(spark, d):
    return r6(bindings.reservations_daily(spark, d), "reserve_lead_time_mean")


@query
def reservation_features(spark, d):
    df = add_bookings(bindings.visits(spark, d), bindings.reservations(spark, d))
    return r6(df.select(*KEYS, *BOOKINGS), "reserve_lead_time_mean")


@query
def reservation_features_as_of(spark, d):
    """Bookings known a fortnight before the end of the panel only."""
    visits = bindings.visits(spark, d)
    cutoff = visits.agg(F.date_sub(F.max(DATE), HORIZON)).scalar().cast("timestamp")
    df = add_bookings(visits, bindings.reservations(spark, d), as_of=cutoff)
    return r6(df.select(*KEYS, *BOOKINGS), "reserve_lead_time_mean")


@query
def entity_stats(spark, d):
    visits = bindings.visits(spark, d)
    rows = visits.withColumn("dow", scalar.day_of_week(DATE)).select(STORE, "dow").distinct()
    df = pick_weekday(rows.join(store_profile(visits), STORE))
    return r6(df, "store_mean", "store_median", "store_dow_mean", "store_dow_median")


@query
def entity_metadata(spark, d):
    return store_metadata(bindings.stores(spark, d))


ROUNDED = [
    *[f"roll_mean_{w}" for w in ROLL_WINDOWS],
    *[f"roll_median_{w}" for w in ROLL_WINDOWS],
    "reserve_lead_time_mean",
    "store_mean",
    "store_median",
    "store_dow_mean",
    "store_dow_median",
]


@query
def feature_matrix(spark, d):
    data = bindings.load(spark, d)
    df = build_features(data, reference=data.visits)
    return r6(r6(df, *ROUNDED), "doy_sin", "doy_cos", digits=9)


@query
def feature_matrix_dense_reference(spark, d):
    """Store levels from the dense grid, closed days included (no reference given)."""
    data = bindings.load(spark, d)
    df = build_features(replace(data, reservations=None, stores=None, holidays=None))
    names = ["store_mean", "store_median", "store_dow_mean", "store_dow_median"]
    return r6(df.select(*KEYS, "reserve_visitors", "reserve_count", "is_holiday", *names), *names)


SUBSET = ["roll_mean_7", "lag_7", "dow", "store_mean"]


@query
def feature_subset(spark, d):
    data = bindings.load(spark, d)
    df = subset_features(build_features(data, reference=data.visits), SUBSET)
    return r6(df, "roll_mean_7", "store_mean")


@query
def log_target_roundtrip(spark, d):
    visits = bindings.visits(spark, d)
    df = visits.withColumn("log_target", scalar.to_log(TARGET)).withColumn(
        "restored", scalar.from_log(F.col("log_target"))
    )
    return r6(df, "log_target", "restored")


# --- temporal validation -------------------------------------------------------------------


def _holdout(visits):
    return splits.final_holdout(panel.last_day(visits), SETTINGS.final_horizon_days)


def _panel(spark, d):
    """The visits as a table: a backtest reads them for its dates, histories, levels and actuals, and each
    reading would sum the raw lines anew."""
    return session.stage(bindings.visits(spark, d), "visits")


def _inputs(spark, d, bookings: bool = False) -> PanelData:
    """All inputs, with visits and calendar as tables: every fold reads them several times, and each
    reading would go over the raw lines anew. So are the daily ``bookings`` for models that use them."""
    data = bindings.load(spark, d)
    if bookings:
        data = replace(data, reservations=session.stage(data.reservations, "bookings"))
    return replace(data, visits=session.stage(data.visits, "visits"), holidays=session.stage(data.holidays, "holidays"))


def _cv(visits, n_folds: int = SETTINGS.n_folds):
    """(panel before the holdout, its rolling-origin splits)."""
    before = splits.train_rows(visits, _holdout(visits))
    return before, splits.rolling_origin_splits(
        panel.last_day(before), n_folds, HORIZON, SETTINGS.cv_stride_days
    )


@query
def holdout_split(spark, d):
    split = _holdout(bindings.visits(spark, d))
    return splits.splits_frame(spark, [split]).drop("fold")


@query
def rolling_splits(spark, d):
    return splits.splits_frame(spark, _cv(bindings.visits(spark, d))[1])


@query
def fold_slices(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    return splits.fold_slices(visits, folds)


@query
def fold_entity_stats(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    df = splits.fold_entity_stats(visits, folds)
    return r6(df, "store_mean", "store_median", "store_dow_mean", "store_dow_median")


@query
def fold_features(spark, d):
    """One fold's training frame, cut from the frame all folds share."""
    data = bindings.load(spark, d)
    visits, folds = _cv(data.visits, 3)
    bt = backtest.Backtest(replace(data, visits=visits), folds, HORIZON)
    names = ["lag_7", "roll_mean_7", "roll_median_28", "store_mean", "store_dow_median"]
    df = bt.fold_features(folds[0])
    return r6(df.select(*KEYS, TARGET, "is_closed", *names), *names)


# --- naive and block forecasts, backtests, reports -----------------------------------------


@query
def naive_onestep(spark, d):
    data = bindings.load(spark, d)
    dense = add_history(panel.densify(data.visits))
    rows = dense.join(store_profile(data.visits), STORE).withColumn(
        "dow", scalar.day_of_week(DATE)
    )
    mean = dense.agg(F.avg(TARGET)).scalar()
    df = pick_weekday(rows)
    return r6(
        df.select(*KEYS, naive_value(df.columns, mean).alias("y_pred")), "y_pred"
    )


@query
def rollout_naive(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    return r6(naive_rollout(visits, folds, HORIZON), "y_pred")


@query
def batch_predict(spark, d):
    return r6(deploy.predict_naive(bindings.visits(spark, d), HORIZON), "y_pred")


def _naive_preds(visits, folds, horizon=HORIZON):
    return backtest.backtest_naive(visits, folds, horizon)


def _block_preds(visits, folds, horizon=HORIZON, context=SETTINGS.max_context):
    return backtest.backtest_block(visits, folds, horizon, WeekdayProfile(), context)


def _cv_preds(spark, d):
    """Scored cross-validation predictions of the two models with an exact SQL form."""
    visits, folds = _cv(_panel(spark, d))
    return union_all(
        [
            _naive_preds(visits, folds).withColumn("model", F.lit("seasonal_naive")),
            _block_preds(visits, folds).withColumn("model", F.lit("window_profile")),
        ]
    )


def _holdout_preds(spark, d):
    visits = bindings.visits(spark, d)
    split = _holdout(visits)
    h = SETTINGS.final_horizon_days
    before = splits.train_rows(visits, split)

    def scored(preds):
        return backtest.score_alignment(preds, visits, [split])

    naive = scored(naive_rollout(before, [split], h))
    block = scored(block_rollout(before, [split], h, WeekdayProfile(), SETTINGS.max_context))
    return union_all(
        [
            naive.withColumn("model", F.lit("seasonal_naive")),
            block.withColumn("model", F.lit("window_profile")),
        ]
    )


@query
def backtest_naive(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    return r6(_naive_preds(visits, folds), "y_pred")


@query
def backtest_window(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    return r6(_block_preds(visits, folds), "y_pred")


SUITE = ("rmsle", "mae", "weighted_mae")


@query
def metrics_overall(spark, d):
    return r6(report.metrics_overall(_cv_preds(spark, d), "model", weights=WEIGHTS), *SUITE)


@query
def error_by_season(spark, d):
    return r6(report.error_by_season(_cv_preds(spark, d), "model", weights=WEIGHTS), *SUITE)


@query
def error_by_region(spark, d):
    stores = bindings.stores(spark, d)
    df = report.error_by_region(_cv_preds(spark, d), stores, "model", weights=WEIGHTS)
    return r6(df, *SUITE)


@query
def error_by_horizon(spark, d):
    return r6(report.error_by_horizon(_cv_preds(spark, d), "model", weights=WEIGHTS), *SUITE)


def _cube(spark, d):
    return report.error_cube(_cv_preds(spark, d), bindings.stores(spark, d), WEIGHTS)


@query
def error_cube(spark, d):
    return r6(_cube(spark, d), *SUITE)


@query
def cv_scores(spark, d):
    return r6(report.cv_scores(_cv_preds(spark, d), "model", weights=WEIGHTS), *SUITE)


@query
def runs_flat(spark, d):
    return r6(report.metric_rows(_cube(spark, d)), "value")


@query
def region_topk(spark, d):
    return report.region_topk(_cube(spark, d))


@query
def ablation_delta(spark, d):
    scores = report.metrics_overall(_cv_preds(spark, d), "model", weights=WEIGHTS)
    df = report.ablation_delta(scores, "seasonal_naive", "window_profile")
    return r6(df, "base_value", "variant_value", "delta", "delta_pct")


@query
def select_best(spark, d):
    """Best configuration per model and the overall winner among a small grid."""
    visits, folds = _cv(bindings.visits(spark, d))
    tries = [("seasonal_naive", _naive_preds(visits, folds))] + [
        ("window_profile", _block_preds(visits, folds, context=c)) for c in CONTEXT_GRID
    ]
    labelled = [
        p.withColumn("model", F.lit(m)).withColumn("ordinal", F.lit(i))
        for i, (m, p) in enumerate(tries)
    ]
    scores = report.cv_scores(union_all(labelled), "model", "ordinal", weights=WEIGHTS)
    best = session.stage(ranking.best_per_model(r6(scores, *SUITE), "rmsle"), "best")
    winner = ranking.best_overall(best, "rmsle").select("model").scalar()
    return best.withColumn("is_winner", (F.col("model") == winner).cast("int"))


@query
def holdout_metrics(spark, d):
    return r6(report.metrics_overall(_holdout_preds(spark, d), "model", weights=WEIGHTS), *SUITE)


@query
def pred_vs_real_daily(spark, d):
    return r6(report.pred_vs_real_daily(_holdout_preds(spark, d)), "y_true", "y_pred")


@query
def residual_histogram(spark, d):
    # Read three times (sketch, counts, bins), so it is computed once into a table.
    preds = session.stage(_holdout_preds(spark, d), "holdout")
    return r6(report.residual_histogram(preds), "left_edge")


@query
def window_forecast(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    df = block_rollout(visits, folds, HORIZON, WeekdayProfile(), SETTINGS.max_context)
    return r6(df, "y_pred")


@query
def window_signal(spark, d):
    visits = bindings.visits(spark, d)
    cutoff = panel.last_day(visits)
    df = signals.window_signal(visits, cutoff, HORIZON, WeekdayProfile(), SETTINGS.max_context)
    return r6(df, *signals.SIGNALS)


def _train_panel(visits):
    return panel.densify(splits.train_rows(visits, _holdout(visits)))


@query
def signal_origins(spark, d):
    return signals.recent_origins(
        _train_panel(bindings.visits(spark, d)), SETTINGS.train_origins
    )


@query
def signal_training_rows(spark, d):
    dense = _train_panel(bindings.visits(spark, d))
    origins = sorted(
        r[0] for r in signals.recent_origins(dense, SETTINGS.train_origins).collect()
    )
    rows = add_history(dense)
    sig = signals.training_signal(dense, origins, HORIZON, WeekdayProfile(), SETTINGS.max_context)
    df = signals.signal_training_rows(rows, sig, origins, HORIZON)
    names = ["sig_point", "sig_q1", "sig_q5", "sig_q9"]
    return r6(df.select(*KEYS, "origin", TARGET, "lag_7", *names), *names)


@query
def signal_store_misses(spark, d):
    """Series of the later half of the folds that no earlier fold already asked for."""
    visits, folds = _cv(bindings.visits(spark, d))
    context = SETTINGS.max_context
    windows = context_windows(visits, [(s.fold, s.train_end) for s in folds], context)
    keyed = signals.with_keys(windows, HORIZON, context, "weekday-v1")
    half = len(folds) // 2
    known = keyed.where(F.col("origin") < half).select("series_key")
    missing = signals.missing_signals(keyed.where(F.col("origin") >= half), known)
    return missing.select(_joined(F.col("ys")).alias("ys"))


# --- importances ---------------------------------------------------------------------------

# Every numeric column of the feature matrix.
IMPORTANCE_FEATURES = [
    *["is_closed", *CALENDAR, *HOLIDAY_FLAGS, "golden_week"],
    *[f"lag_{k}" for k in LAGS],
    *[f"roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("mean", "median")],
    *[*BOOKINGS, *LEVELS],
]


def _importances(spark, d):
    """A model-free importance: absolute correlation of each feature with the target."""
    data = bindings.load(spark, d)
    frame = build_features(data, reference=data.visits)
    long = profile.correlation_with(frame, TARGET, IMPORTANCE_FEATURES)
    value = F.round(F.coalesce("abs_corr", F.lit(0.0)), 6)
    return long.select("feature", value.alias("value"))


@query
def importance_topk(spark, d):
    return r6(ranking.importance_topk(_importances(spark, d), 15), "share_pct")


@query
def feature_select(spark, d):
    return ranking.select_by_share(_importances(spark, d), SETTINGS.feature_select_threshold)


# --- exploratory profile -------------------------------------------------------------------

PROFILED = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)


@query
def null_profile(spark, d):
    frames = {t: bindings.table(spark, d, t) for t in PROFILED}
    return profile.null_profile(frames)


@query
def null_profile_features(spark, d):
    """Nulls of the lag and rolling columns: the warm-up rows of each store."""
    df = add_history(panel.densify(bindings.visits(spark, d)))
    return profile.null_profile({"history": df})


@query
def duplicate_keys(spark, d):
    lines = bindings.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias(STORE), F.to_date("l_shipdate").alias(DATE)
    )
    return profile.duplicate_keys(lines, *KEYS)


@query
def cardinality(spark, d):
    stores = bindings.stores(spark, d)
    relation = bindings.store_relation(spark, d)
    return profile.cardinality(
        {
            "visit_stores": (bindings.table(spark, d, "lineitem"), "l_suppkey"),
            "stores": (stores, STORE),
            "genres": (stores, "genre"),
            "areas": (stores, "area"),
            "mapped_ids": (relation, "hpg_store_id"),
        }
    )


@query
def value_counts(spark, d):
    stores, holidays = bindings.stores(spark, d), bindings.holidays(spark, d)
    visits = bindings.visits(spark, d)
    by_day = visits.select(F.date_format(DATE, "EEEE").alias("day_name"))
    df = profile.value_counts(
        {
            "genre": (stores, "genre"),
            "prefecture": (store_metadata(stores), "area_prefecture"),
            "day_of_week": (by_day, "day_name"),
            "is_holiday": (visits.join(holidays, DATE), "is_holiday"),
        }
    )
    return r6(df, "share")


@query
def describe_target(spark, d):
    return r6(profile.describe(bindings.visits(spark, d)), "mean", "std", "p25", "p50", "p75")


@query
def skew_target(spark, d):
    return r6(profile.skew(bindings.visits(spark, d)), "skew_raw", "skew_log1p")


@query
def target_histogram(spark, d):
    return r6(profile.target_histogram(bindings.visits(spark, d)), "left_edge")


@query
def mean_by_dow(spark, d):
    return r6(profile.mean_by_weekday(bindings.visits(spark, d)), "mean_visitors")


@query
def mean_by_holiday(spark, d):
    df = profile.mean_by_holiday(bindings.visits(spark, d), bindings.holidays(spark, d))
    return r6(df, "mean_visitors")


@query
def mean_by_day(spark, d):
    return r6(profile.mean_by(bindings.visits(spark, d), F.col(DATE), DATE), "mean_visitors")


CORRELATED = [
    "reserve_visitors", "is_holiday", "dow", "day_of_month", "month",
    "lag_1", "lag_7", "roll_7_mean", "store_mean",
]


def _observed_panel(spark, d):
    data = bindings.load(spark, d)
    df = observed_history(data.visits)
    df = add_holidays(add_calendar(df), data.holidays)
    return add_bookings(df, data.reservations)


@query
def corr_with_target(spark, d):
    df = profile.correlation_with(_observed_panel(spark, d), TARGET, CORRELATED)
    return r6(df, "corr", "abs_corr")


@query
def corr_matrix(spark, d):
    df = profile.correlation_pairs(_observed_panel(spark, d), [TARGET, *CORRELATED])
    return r6(df, "corr")


@query
def reservation_lift(spark, d):
    daily = daily_bookings(bindings.reservations(spark, d))
    df = profile.reservation_lift(bindings.visits(spark, d), daily)
    return r6(df, "reserved_share", "corr_reserved", "mean_reserved", "mean_unreserved")


@query
def store_sample(spark, d):
    return profile.first_stores(bindings.visits(spark, d), 2)


@query
def row_sample(spark, d):
    """A seeded random sample of at most 8,000 booked store days (a scatter plot's input)."""
    df = add_bookings(bindings.visits(spark, d), bindings.reservations(spark, d))
    booked = df.where(F.col("reserve_visitors") > 0).select(*KEYS, TARGET, "reserve_visitors")
    return profile.sample_rows(booked, 8000, *KEYS)


# --- trained models with an exact SQL form ---------------------------------------------------

# One split on the closed flag: each leaf is the mean log target of its rows.
STUMP = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "subsample": 1.0, "colsample": 1.0}


def _stump_frame(spark, d) -> DataFrame:
    return panel.densify(bindings.visits(spark, d)).select(*KEYS, TARGET, "is_closed")


@query
def stump_fit_predict(spark, d):
    return r6(_fit_predict(BoostedTrees(STUMP), _stump_frame(spark, d)), "y_pred")


@query
def stump_importance(spark, d):
    return BoostedTrees(STUMP).fit(_stump_frame(spark, d)).feature_importance()


@query
def stump_rollout(spark, d):
    data = backtest.prepare(bindings.load(spark, d))
    model = BoostedTrees(STUMP).fit(_stump_frame(spark, d))
    days = rollout.rollout(model, data, data.visits, panel.last_day(data.visits), HORIZON)
    return r6(days.select(*KEYS, "y_pred"), "y_pred")


# --- trained models (no SQL form) ----------------------------------------------------------

TREES = {"n_estimators": 5, "max_depth": 4}

# Whole models: the first configurations of the selection, with all of their 300 trees.
DEEP = {"learning_rate": 0.05, "max_depth": 6}
SHALLOW = {"learning_rate": 0.05, "num_leaves": 31}


def _tree_frame(spark, d) -> tuple[PanelData, DataFrame]:
    data = _inputs(spark, d, bookings=True)
    return data, build_features(data, reference=data.visits)


def _fit_predict(model, frame):
    return model.fit(frame).predict(frame).select(*KEYS, TARGET, "y_pred")


@query
def gbt_fit_predict(spark, d):
    return _fit_predict(BoostedTrees(DEEP), _tree_frame(spark, d)[1])


@query
def gbt_shallow_fit_predict(spark, d):
    return _fit_predict(BoostedTrees(SHALLOW), _tree_frame(spark, d)[1])


@query
def gbt_importance(spark, d):
    model = BoostedTrees(TREES).fit(_tree_frame(spark, d)[1])
    return ranking.importance_topk(model.feature_importance())


@query
def rollout_gbt(spark, d):
    data, frame = _tree_frame(spark, d)
    model = BoostedTrees(TREES).fit(frame)
    return rollout.rollout(model, data, data.visits, panel.last_day(data.visits), HORIZON)


@query
def backtest_gbt(spark, d):
    data = bindings.load(spark, d)
    visits, folds = _cv(data.visits, 2)
    bt = backtest.Backtest(replace(data, visits=visits), folds, HORIZON)
    spec = selection.ModelSpec("gbt", BoostedTrees, TREES, is_tree=True)
    return bt.predictions(spec)


def _fused():
    return FusedTrees(DEEP, WeekdayProfile(), HORIZON, SETTINGS.max_context, SETTINGS.train_origins)


@query
def hybrid_fit_predict(spark, d):
    model, frame = _fused(), _tree_frame(spark, d)[1]
    rows = model.training_rows(frame)
    model.fit(frame)
    return model.predict(rows).select(*KEYS, TARGET, "sig_point", "y_pred")


@query
def rollout_hybrid(spark, d):
    data, frame = _tree_frame(spark, d)
    model = _fused().fit(frame)
    return rollout.rollout(model, data, data.visits, panel.last_day(data.visits), HORIZON)


@query
def holdout_report(spark, d):
    data = _inputs(spark, d, bookings=True)
    spec = selection.ModelSpec("gbt", BoostedTrees, DEEP, is_tree=True)
    return selection.holdout_report(data, spec, SETTINGS)


@query
def model_selection(spark, d):
    """The four-step selection over small grids; returns every score it compared."""
    small = [
        selection.ModelSpec("seasonal_naive", selection.SeasonalNaive),
        selection.ModelSpec(
            "window_profile",
            lambda p: selection.BlockModel(WeekdayProfile(), p),
            {"max_context": 512},
            [{"max_context": 512}, {"max_context": 112}],
        ),
        selection.ModelSpec("gbt", BoostedTrees, TREES, [TREES], True),
    ]
    result = selection.ModelSelection(small, SETTINGS).run(bindings.load(spark, d), n_folds=1)
    return result.scores
