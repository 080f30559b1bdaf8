"""Queries on hierarchies, intermittent demand, drift, smoothing, capping and booking cutoffs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelcast.catalog.queries import HORIZON, IMPORTANCE_FEATURES, SETTINGS, STUMP, _cv, _holdout, _inputs, query, r6, union_all
from panelcast.models.intermittent import demand_states, intermittent_rollout
from panelcast.models.naive import naive_rollout
from panelcast.models.trees import BoostedTrees
from panelcast.operators import bookings, capping, clusters, drift, hierarchy, panel, profile, smoothing, splits, weather
from panelcast.operators.history import add_spread
from panelcast.plans import backtest, selection
from panelcast.plans.features import build_features
from panelcast.schema import DATE, KEYS, ROLL_WINDOWS, STORE, TARGET
from panelcast.session import stage
from panelcast.sources import bindings

ALPHA = 0.1
CLUSTERS = 6


def _levels(spark, d, staged=True):
    """The panel of all nodes of the store tree, and the tree; as tables if they are read several times."""
    visits = bindings.visits(spark, d)
    paths = hierarchy.store_paths(visits, bindings.stores(spark, d))
    nodes, tree = hierarchy.level_panels(visits, paths), hierarchy.tree_of(paths)
    return (stage(nodes, "level-panels"), stage(tree, "store-tree")) if staged else (nodes, tree)


@query
def store_tree(spark, d):
    return _levels(spark, d, staged=False)[1]


@query
def level_panels(spark, d):
    return _levels(spark, d, staged=False)[0]


def _reconciled(spark, d):
    """Forecasts after the holdout's start; the error of each level is that of all folds before it."""
    nodes, tree = _levels(spark, d)
    split = _holdout(nodes)
    before, folds = _cv(nodes)
    variances = hierarchy.level_variances(backtest.backtest_naive(before, folds, HORIZON), tree)
    base = naive_rollout(before, [split], HORIZON).select(F.col(STORE).alias("node"), DATE, "y_pred")
    return hierarchy.reconcile(base, tree, variances)


@query
def level_variances(spark, d):
    nodes, tree = _levels(spark, d)
    before, folds = _cv(nodes)
    return r6(hierarchy.level_variances(backtest.backtest_naive(before, folds, HORIZON), tree), "variance")


@query
def reconciled_forecast(spark, d):
    return r6(_reconciled(spark, d), "y_pred", "y_reconciled")


@query
def intermittent_states(spark, d):
    """Smoothed demand size and interval of every store at every fold's cutoff."""
    visits, folds = _cv(bindings.visits(spark, d))
    return r6(demand_states(visits, folds, ALPHA, ALPHA), "z", "p")


@query
def backtest_intermittent(spark, d):
    visits, folds = _cv(bindings.visits(spark, d))
    preds = intermittent_rollout(visits, folds, HORIZON, ALPHA, ALPHA)
    return r6(backtest.score_alignment(preds, visits, folds), "y_pred")


@query
def store_drift(spark, d):
    """The holdout's days against all days before it, per store."""
    visits = bindings.visits(spark, d)
    found = drift.monitor(visits, _holdout(visits).valid_start)
    return r6(found.withColumn("drifted", F.col("drifted").cast("int")), "stability_index", "distance", "rise", "fall")


@query
def ewm_features(spark, d):
    df = smoothing.add_ewm(panel.densify(bindings.visits(spark, d)))
    names = [smoothing.ewm_column(r) for r in smoothing.RATES]
    return r6(df.select(*KEYS, *names), *names)


@query
def backtest_bookings_as_of(spark, d):
    """The booking columns of every fold's window as they stood at its cutoff."""
    _, folds = _cv(bindings.visits(spark, d))
    known = bookings.known_bookings(bookings.booking_cube(bindings.reservations(spark, d)), folds)
    return r6(known, "reserve_lead_time_mean")


@query
def corr_features(spark, d):
    """Every pair of numeric columns of the feature matrix, the target included."""
    data = bindings.load(spark, d)
    frame = build_features(data, reference=data.visits)
    return r6(profile.correlation_matrix(frame, [TARGET, *IMPORTANCE_FEATURES]), "corr")


@query
def rolling_spread(spark, d):
    df = add_spread(panel.densify(bindings.visits(spark, d)))
    names = [f"roll_{s}_{w}" for w in ROLL_WINDOWS for s in ("std", "min", "max", "q90")]
    return r6(df.select(*KEYS, *names), *names)


@query
def nearest_stations(spark, d):
    return r6(weather.nearest_stations(bindings.locations(spark, d), bindings.stations(spark, d)), "distance")


@query
def weather_features(spark, d):
    """The last reading of each store's nearest station up to every observed day."""
    inputs = [f(spark, d) for f in (bindings.locations, bindings.stations, bindings.readings)]
    return r6(weather.add_weather(bindings.visits(spark, d).select(*KEYS), *inputs), "distance", "weather")


@query
def location_clusters(spark, d):
    """Each store's cluster by centres of the stores seen before the holdout, and the centre."""
    visits, stores = bindings.visits(spark, d), bindings.locations(spark, d)
    seen = splits.train_rows(visits, _holdout(visits)).select(STORE).distinct()
    model = clusters.LocationClusters(CLUSTERS).fit(stores.join(seen, STORE, "left_semi"))
    centre = F.get(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in model.centres]), F.col("location_cluster"))
    df = model.assign(stores).select(STORE, "location_cluster", centre["y"].alias("centre_lat"), centre["x"].alias("centre_lon"))
    return r6(df, "centre_lat", "centre_lon")


@query
def fold_features_all(spark, d):
    """Rows and column sums of every fold's training frame, by whether the day was closed."""
    data = _inputs(spark, d)
    visits, folds = _cv(data.visits)
    bt = backtest.Backtest(replace(data, visits=visits), folds, HORIZON)
    names = [TARGET, "lag_7", "roll_mean_7", "roll_median_28", "store_mean", "store_dow_median", "reserve_visitors"]
    frames = bt.all_fold_features([*names, "is_closed"]).groupBy("fold", "is_closed")
    return r6(frames.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]), *names, digits=3)


@query
def backtest_stump(spark, d):
    """A one-split tree, fitted anew in each of all folds and rolled out day by day."""
    data = _inputs(spark, d)
    visits, folds = _cv(data.visits)
    bt = backtest.Backtest(replace(data, visits=visits), folds, HORIZON, parallel=4)
    spec = backtest.ModelSpec("stump", BoostedTrees, STUMP, is_tree=True)
    return r6(bt.predictions(spec, selected=["is_closed"]), "y_pred")


@query
def holdout_stump(spark, d):
    """The holdout report of a one-split tree: fitted before the last weeks, met with the actuals."""
    spec = backtest.ModelSpec("stump", BoostedTrees, STUMP, is_tree=True)
    return r6(selection.holdout_report(_inputs(spark, d), spec, SETTINGS, selected=["is_closed"]), "y_pred")


@query
def capped_visits(spark, d):
    """All days, with targets limited to the quantiles of the days before the holdout."""
    visits = bindings.visits(spark, d)
    return r6(capping.cap_outliers(visits, splits.train_rows(visits, _holdout(visits))), TARGET)
