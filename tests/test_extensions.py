"""Hierarchies, intermittent demand, drift, exponentially weighted means and capping."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import PANEL, ramp
from pyspark.sql import functions as F

from panelcast.models.base import Forecaster
from panelcast.models.intermittent import IntermittentDemand, demand_states
from panelcast.models.trees import BoostedTrees
from panelcast.operators import capping, clusters, drift, hierarchy, smoothing, weather
from panelcast.operators.history import add_spread
from panelcast.operators.panel import densify, last_day
from panelcast.operators.splits import Split
from panelcast.plans import backtest, rollout, selection
from panelcast.plans.features import build_features
from panelcast.schema import DATE, STORE, TARGET, PanelData, Settings

DAY = date(2016, 1, 1)


def test_reconciled_forecasts_equal_a_dense_solve(spark):
    stores = spark.createDataFrame(
        [("a", "g", "P1 W1"), ("b", "g", "P1 W1"), ("c", "g", "P1 W2"), ("d", "g", "P2 W1"), ("e", "g", None)],
        "store_id string, genre string, area string",
    )
    paths = hierarchy.store_paths(stores, stores)
    tree = hierarchy.tree_of(paths)
    nodes = {r["node"]: r for r in tree.collect()}
    assert len(nodes) == 1 + 3 + 4 + 5 and nodes["total/unknown/unknown/e"]["depth"] == 3
    variances = {0: 9.0, 1: 4.0, 2: 2.0, 3: 0.5}
    draw = np.random.default_rng(3)
    base = {n: float(draw.uniform(0, 20)) for n in nodes}
    days = [(n, DAY, y) for n, y in base.items()] + [(n, DAY + timedelta(days=1), 1.0) for n in nodes]
    frame = spark.createDataFrame(days, "node string, date date, y_pred double")
    out = hierarchy.reconcile(frame, tree, spark.createDataFrame(list(variances.items()), "depth int, variance double"))
    rows = [r for r in out.collect() if r[DATE] == DAY]
    assert len(rows) == len(nodes)
    leaves = sorted(n for n in nodes if nodes[n]["depth"] == 3)
    names = sorted(nodes)
    s = np.array([[leaf == n or leaf.startswith(f"{n}/") for leaf in leaves] for n in names], float)
    w = np.diag([1 / variances[nodes[n]["depth"]] for n in names])
    y = np.array([base[n] for n in names])
    want = dict(zip(names, s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ y), strict=True))
    got = {r["node"]: r["y_reconciled"] for r in rows}
    assert got == pytest.approx(want)
    for n in names:
        below = [got[c] for c in names if nodes[c]["parent"] == n]
        assert not below or got[n] == pytest.approx(sum(below))
    none = hierarchy.reconcile(frame.limit(0), tree, spark.createDataFrame([], "depth int, variance double"))
    assert none.count() == 0


def test_a_node_without_forecast_takes_its_children(spark):
    one = spark.createDataFrame([("a",), ("b",)], "store_id string")
    tree = hierarchy.tree_of(hierarchy.store_paths(one, None))
    leaves = [(f"total/unknown/unknown/{s}", DAY, y) for s, y in (("a", 2.0), ("b", 3.0))]
    base = spark.createDataFrame(leaves, "node string, date date, y_pred double")
    out = hierarchy.reconcile(base, tree, spark.createDataFrame([(3, 0.0)], "depth int, variance double"))
    assert {r["node"]: r["y_reconciled"] for r in out.collect()}["total"] == pytest.approx(5.0)


def _plain_states(demands, cutoff, alpha, beta):
    z = p = last = None
    for day, y in demands:
        if day > cutoff or y <= 0:
            continue
        z, p = (y, 1.0) if last is None else (z + alpha * (y - z), p + beta * ((day - last).days - p))
        last = day
    return z, p


def test_intermittent_states_equal_a_plain_loop(spark):
    draw = np.random.default_rng(1)
    rows = [("a", DAY + timedelta(days=int(i)), float(draw.integers(0, 9))) for i in sorted(draw.choice(300, 60, replace=False))]
    rows += [("b", DAY + timedelta(days=290), 4.0), ("c", DAY, 0.0)]
    folds = [Split(k, DAY + timedelta(days=40 * k), DAY, DAY) for k in range(8)]
    out = {(r["fold"], r[STORE]): (r["z"], r["p"]) for r in demand_states(spark.createDataFrame(rows, PANEL), folds, 0.2, 0.3).collect()}
    for s in folds:
        want = _plain_states([(d, y) for n, d, y in rows if n == "a"], s.train_end, 0.2, 0.3)
        assert (out.get((s.fold, "a")) or (None, None)) == pytest.approx(want)
    assert not any(store in "bc" for fold, store in out if fold < 7)


def test_intermittent_model_in_the_registry(spark, tmp_path):
    rows = [("a", DAY + timedelta(days=5 * i), 10.0) for i in range(30)] + [("b", DAY, 0.0)]
    visits = spark.createDataFrame(rows, PANEL)
    model = IntermittentDemand({"alpha": 0.2, "unbiased": False}).fit(visits)
    cutoff = DAY + timedelta(days=145)
    out = rollout.rollout(model, PanelData(visits), visits, cutoff, 7).collect()
    assert len(out) == 14 and {r["y_pred"] for r in out if r[STORE] == "b"} == {0.0}
    rate = {r["y_pred"] for r in out if r[STORE] == "a"}
    assert len(rate) == 1 and rate.pop() == pytest.approx(2.0, abs=0.1)
    model.save(f"{tmp_path}/m")
    again = IntermittentDemand().load(spark, f"{tmp_path}/m")
    assert (again.alpha, again.beta, again.unbiased) == (0.2, 0.2, False)
    specs = {s.name: s for s in selection.default_registry(Settings(), intermittent=True)}
    folds = [Split(0, cutoff - timedelta(days=20), cutoff - timedelta(days=19), cutoff)]
    scored = backtest.Backtest(PanelData(visits), folds, 20).predictions(specs["intermittent"])
    assert scored.count() == 4
    assert "intermittent" not in {s.name for s in selection.default_registry(Settings())}


def test_planted_shift_is_found_and_nothing_else(spark):
    draw = np.random.default_rng(8)
    since = DAY + timedelta(days=300)
    rows = []
    for store, shift in (("same", 0), ("up", 15), ("down", -12)):
        for i in range(360):
            y = 30 + 6 * np.sin(2 * np.pi * i / 7) + draw.normal(0, 4) + (shift if i >= 320 else 0)
            rows.append((store, DAY + timedelta(days=i), float(max(0, round(y)))))
    rows += [("closed", DAY, 5.0), ("new", since, 5.0)]
    out = {r[STORE]: r for r in drift.monitor(spark.createDataFrame(rows, PANEL), since).collect()}
    assert len(out) == 5
    assert {n for n, r in out.items() if r["drifted"]} == {"up", "down"}
    planted = DAY + timedelta(days=320)
    assert all(planted <= out[n]["first_alarm"] <= planted + timedelta(days=7) for n in ("up", "down"))
    assert out["up"]["rise"] > 20 > out["up"]["fall"] and out["down"]["fall"] > 20 > out["down"]["rise"]
    assert out["up"]["stability_index"] > 4 * out["same"]["stability_index"]
    assert out["new"]["stability_index"] is None and out["closed"]["distance"] is None


def test_sketches_add_up(spark):
    rows = [("s", DAY + timedelta(days=i), float(i % 17)) for i in range(100)]
    recent = F.col(DATE) >= F.lit(DAY + timedelta(days=60))
    whole = drift.sketch(spark.createDataFrame(rows, PANEL), recent)
    parts = [drift.sketch(spark.createDataFrame(p, PANEL), recent) for p in (rows[:37], rows[37:])]
    summed = parts[0].unionByName(parts[1]).groupBy(STORE, "bin").agg(F.sum("base").alias("base"), F.sum("recent").alias("recent"))
    assert sorted(summed.collect()) == sorted(whole.collect())


def _plain_ewm(values, rate):
    out, e = [], None
    for y in values:
        out.append(e)
        e = y if e is None else rate * y + (1 - rate) * e
    return out, e


@pytest.mark.parametrize("block", [256, 16])
def test_ewm_equals_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(smoothing, "BLOCK", block)
    monkeypatch.setattr(smoothing, "REACH", 1024 // block)
    draw = np.random.default_rng(5)
    values = {"a": draw.poisson(20, 1100).astype(float).tolist(), "b": [3.0], "c": [0.0] * 40 + [7.0] * 3}
    rows = [(s, DAY + timedelta(days=i), y) for s, ys in values.items() for i, y in enumerate(ys)]
    rates = (0.05, 0.1, 0.3, 0.9)
    dense = densify(spark.createDataFrame(rows, PANEL))
    got = smoothing.add_ewm(dense, rates).orderBy(STORE, DATE).collect()
    states = {r[STORE]: r["_ewm"] for r in smoothing.ewm_state(dense, rates).collect()}
    for s, ys in values.items():
        for i, rate in enumerate(rates):
            want, last = _plain_ewm(ys, rate)
            column = [r[smoothing.ewm_column(rate)] for r in got if r[STORE] == s]
            assert column[0] is None and column[1:] == pytest.approx(want[1:], rel=1e-9)
            assert states[s][i] == pytest.approx(last, rel=1e-9)


class _FollowsMean(Forecaster):
    """Forecasts its own slow mean plus one, so that each step shows the state it was given."""

    smoothing = (0.3, 0.1)

    def fit(self, train):
        return self

    def predict(self, features):
        return features.withColumn("y_pred", F.col("ewm_10") + 1.0)

    def save(self, path): ...

    def load(self, spark, path):
        return self


def test_rollout_carries_the_means(spark):
    visits = ramp(spark, 150)
    cutoff = last_day(visits)
    got = rollout.rollout(_FollowsMean(), PanelData(visits), visits, cutoff, 12, checkpoint_every=5).orderBy(DATE).collect()
    values = [10.0 + i for i in range(150)]
    for r in got:
        values.append(_plain_ewm(values, 0.1)[1] + 1.0)
        assert r["y_pred"] == pytest.approx(values[-1])
    assert len(got) == 12


def test_trees_learn_from_the_means(spark, data):
    frame = build_features(data, reference=data.visits, ewm=(0.3,)).select(STORE, DATE, TARGET, "dow", "ewm_30", "lag_7")
    model = BoostedTrees({"n_estimators": 2, "max_depth": 2}).fit(frame)
    assert model.smoothing == (0.3,) and model.features_[0] == "dow"
    out = rollout.rollout(model, data, data.visits, last_day(data.visits), 3)
    assert out.count() == 9 and out.where("y_pred IS NULL OR y_pred < 0").count() == 0


def test_caps_are_each_stores_own(spark):
    rows = [("a", DAY + timedelta(days=i), float(i)) for i in range(101)] + [("b", DAY, 1000.0)]
    panel = spark.createDataFrame(rows + [("a", DAY + timedelta(days=200), 500.0), ("c", DAY, None)], PANEL)
    reference = spark.createDataFrame(rows, PANEL)
    out = capping.cap_outliers(panel, reference, 0.05, 0.95)
    assert out.columns == [STORE, DATE, TARGET, "is_capped"]
    got = {(r[STORE], r[DATE]): (r[TARGET], r["is_capped"]) for r in out.collect()}
    assert got["a", DAY] == (5.0, 1) and got["a", DAY + timedelta(days=200)] == (95.0, 1)
    assert got["a", DAY + timedelta(days=50)] == (50.0, 0) and got["b", DAY] == (1000.0, 0)
    assert got["c", DAY] == (None, 0)


def test_nearest_station_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    near = draw.normal(0, 0.01, (300, 2))  # a crowd of stations in one place
    spots = np.vstack([near, draw.uniform(-60, 60, (40, 2)), near[:5]])
    stations = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(spots)] + [(999, None, 1.0)], "station_id long, lat double, lon double")
    places = np.vstack([draw.normal(0, 0.02, (30, 2)), draw.uniform(-90, 90, (60, 2)), spots[300:303]])
    df = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(places)] + [(500, None, None)], "store_id long, lat double, lon double")
    got = {r[STORE]: (r["station_id"], r["distance"]) for r in weather.nearest_stations(df, stations).collect()}
    assert len(got) == len(places)
    for i, p in enumerate(places):
        far = np.sqrt(((spots - p) ** 2).sum(axis=1))
        assert got[i][0] == int(np.argmin(far)) and got[i][1] == pytest.approx(far.min())
    assert weather.nearest_stations(df, stations.limit(0)).count() == 0
    assert weather.nearest_stations(df.limit(0), stations).count() == 0


def test_weather_is_the_last_reading_before(spark):
    stations = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "station_id long, lat double, lon double")
    places = spark.createDataFrame([("a", 1.0, 1.0), ("b", 8.0, 8.0), ("c", None, None)], "store_id string, lat double, lon double")
    at = [datetime(2016, 1, 3, 8), datetime(2016, 1, 3, 20), datetime(2016, 1, 7)]
    readings = spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(at)] + [(1, at[2], None), (7, at[0], 5.0)], "station_id long, ts timestamp, value double")
    panel = spark.createDataFrame([(s, DAY + timedelta(days=d), 1.0) for s in "abc" for d in (0, 2, 4, 9)], PANEL)
    out = {(r[STORE], r[DATE].day): r for r in weather.add_weather(panel, places, stations, readings).collect()}
    assert len(out) == 12
    assert [(out["a", d]["weather"], out["a", d]["weather_age"]) for d in (1, 3, 5, 10)] == [(None, None), (1.0, 0), (1.0, 2), (2.0, 3)]
    assert out["b", 10]["station_id"] == 2 and out["b", 10]["weather"] is None
    assert out["c", 10]["station_id"] is None and out["c", 10][TARGET] == 1.0


def test_location_clusters_are_fitted_per_fold_and_kept(spark, tmp_path):
    draw = np.random.default_rng(7)
    middles = np.array([(0, 0), (10, 10), (-10, 10)])
    rows = [(f"s{i}", *map(float, middles[i % 3] + draw.normal(0, 0.3, 2))) for i in range(60)]
    stores = spark.createDataFrame(rows + [("none", None, None)], "store_id string, lat double, lon double")
    model = clusters.LocationClusters(3).fit(stores)
    found = {r[STORE]: r["location_cluster"] for r in model.assign(stores).collect()}
    assert found.pop("none") is None
    far = lambda r, c: (r[1] - c[0]) ** 2 + (r[2] - c[1]) ** 2
    assert all(found[r[0]] == min(range(3), key=lambda i: far(r, model.centres[i])) for r in rows)  # noqa: B023
    model.save(spark, f"{tmp_path}/c")
    assert clusters.LocationClusters().load(spark, f"{tmp_path}/c").centres == model.centres
    early = spark.createDataFrame([(r[0], DAY + timedelta(days=0 if i % 3 == 0 else 50), 1.0) for i, r in enumerate(rows)], PANEL)
    split = Split(0, DAY + timedelta(days=10), DAY, DAY)
    per_fold = clusters.fold_clusters(stores, early, split, 2)
    assert per_fold.count() == 61 and per_fold.where("location_cluster IS NULL").count() == 1
    seen = clusters.LocationClusters(2).fit(stores.join(early.where(F.col(DATE) == F.lit(DAY)), STORE, "left_semi"))
    assert all(abs(y) < 2 and abs(x) < 2 for y, x in seen.centres)
    assert clusters.LocationClusters(3).fit(stores.limit(0)).assign(stores).where("location_cluster IS NOT NULL").count() == 0


def test_rolling_spread(spark):
    draw = np.random.default_rng(3)
    values = draw.poisson(9, 40).astype(float)
    rows = [("s", DAY + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    out = add_spread(densify(spark.createDataFrame(rows, PANEL)), (7,)).orderBy(DATE).collect()
    assert out[6]["roll_std_7"] is None and out[7]["roll_std_7"] is not None
    for i in range(7, 40):
        w = values[i - 7 : i]
        want = (w.std(ddof=1), w.min(), w.max(), np.quantile(w, 0.9))
        assert [out[i][f"roll_{n}_7"] for n in ("std", "min", "max", "q90")] == pytest.approx(want)


def test_spread_sorts_gathered_values_and_keeps_its_results(spark):
    """No percentile over a sliding frame; equal to frames of their own."""
    from pyspark.sql import Window

    rows = [("s", date(2016, 1, 1) + timedelta(days=i), float((i * 37) % 11) + i / 8) for i in range(60)]
    dense = densify(spark.createDataFrame(rows, PANEL))
    out = add_spread(dense)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    frame = Window.partitionBy("store_id").orderBy(DATE).rowsBetween(-28, -1)
    parts = {"std": F.stddev_samp(TARGET), "min": F.min(TARGET), "max": F.max(TARGET), "q90": F.percentile(TARGET, 0.9)}
    want = dense.select(DATE, *[part.over(frame).alias(name) for name, part in parts.items()])
    both = out.join(want, DATE).orderBy(DATE).collect()
    for i, r in enumerate(both):
        for name in parts:
            got = r[f"roll_{name}_28"]
            assert got is None if i < 28 else got == pytest.approx(r[name], abs=1e-12)
