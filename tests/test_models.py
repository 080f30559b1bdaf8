import gzip
import sys
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import PANEL, ramp
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelcast import PanelData, Settings, session
from panelcast.models.base import Forecaster, ImportanceForecaster
from panelcast.models.hybrid import FusedTrees
from panelcast.models.naive import SeasonalNaive, naive_rollout
from panelcast.models.trees import BoostedTrees
from panelcast.models.window import BlockModel, PandasBlock, WeekdayProfile
from panelcast.operators.splits import rolling_origin_splits, train_rows
from panelcast.plans import deploy, selection
from panelcast.plans.backtest import Backtest, ModelSpec
from panelcast.plans.features import build_features
from panelcast.plans.rollout import rollout
from panelcast.plans.signals import SignalStore, training_signal, window_signal
from panelcast.plans.windows import context_windows
from panelcast.sources import sinks
from panelcast.sources.tables import check_contract, read_csv_folder

# Workers cannot import this module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL = {"n_estimators": 2, "max_depth": 3}


class Echo(Forecaster):
    """Yesterday plus one."""

    def fit(self, train):
        return self

    def predict(self, features):
        return features.withColumn("y_pred", F.col("lag_1") + 1)

    def save(self, path): ...

    def load(self, spark, path):
        return self


def last_plus(series, horizon):
    point = np.array([[s[-1] + k + 1 for k in range(horizon)] for s in series])
    return point, np.repeat(point[:, :, None], 10, axis=2)


def constant(spark, store, value, n, start=date(2016, 1, 1)):
    rows = [(store, start + timedelta(days=i), value) for i in range(n)]
    return spark.createDataFrame(rows, PANEL)


def test_contracts_cannot_be_instantiated():
    for cls in (Forecaster, ImportanceForecaster):
        with pytest.raises(TypeError):
            cls()


def test_each_prediction_feeds_the_next_day(spark):
    visits = constant(spark, "s", 10.0, 40)
    out = rollout(Echo(), PanelData(visits), visits, date(2016, 2, 9), 3, checkpoint_every=2)
    assert [r["y_pred"] for r in out.orderBy("date").collect()] == [11.0, 12.0, 13.0]
    assert out.agg(F.min("date")).first()[0] == date(2016, 2, 10)


def test_block_model_forecasts_all_days_at_once(spark):
    visits = constant(spark, "a", 5.0, 10).unionByName(constant(spark, "b", 8.0, 10))
    model = BlockModel(PandasBlock(last_plus)).fit(visits)
    out = rollout(model, PanelData(visits), visits, date(2016, 1, 10), 2)
    got = {(r["store_id"], r["date"].day): r["y_pred"] for r in out.collect()}
    assert got == {("a", 11): 6.0, ("a", 12): 7.0, ("b", 11): 9.0, ("b", 12): 10.0}


def test_block_model_falls_back_to_the_global_mean(spark):
    visits = constant(spark, "a", 4.0, 10)
    model = BlockModel(WeekdayProfile(), {"max_context": 5}).fit(visits)
    stale = visits.unionByName(constant(spark, "late", 9.0, 3, date(2016, 3, 1)))
    out = model.forecast_block(stale, date(2016, 1, 10), 1)
    assert {r["store_id"]: r["y_pred"] for r in out.collect()}["late"] == 4.0


def test_naive_closed_form_equals_the_day_loop(spark, data):
    """Gaps, a store that stopped long ago, a new store and a mid-gap cutoff."""
    extra = constant(spark, "gone", 3.0, 20).unionByName(
        constant(spark, "new", 6.0, 4, date(2016, 5, 28))
    )
    holes = data.visits.where("NOT (store_id = 'b' AND date > '2016-05-24')").unionByName(extra)
    cutoff = date(2016, 5, 31)
    split = rolling_origin_splits(cutoff + timedelta(days=16), 1, 16)[0]
    closed = naive_rollout(holes, [split], 16)
    frame = build_features(PanelData(holes), reference=holes)
    loop = rollout(SeasonalNaive().fit(frame), PanelData(holes), holes, cutoff, 16)
    a = {(r["store_id"], r["date"]): r["y_pred"] for r in closed.collect()}
    b = {(r["store_id"], r["date"]): r["y_pred"] for r in loop.collect()}
    assert a.keys() == b.keys() and len(a) == 5 * 16
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_naive_one_step_is_the_week_before(spark):
    frame = build_features(PanelData(ramp(spark, 20)))
    model = SeasonalNaive().fit(frame)
    got = model.predict(frame).where("date = '2016-01-15'").first()
    assert got["y_pred"] == got["lag_7"] == 17.0


def test_naive_keeps_its_state(spark, tmp_path):
    model = SeasonalNaive().fit(ramp(spark, 3))
    model.save(f"{tmp_path}/m")
    assert SeasonalNaive().load(spark, f"{tmp_path}/m").global_mean == 11.0


@pytest.fixture(scope="module")
def fitted(spark, data):
    frame = session.stage(build_features(data, reference=data.visits), "test-frame")
    return BoostedTrees(SMALL).fit(frame), frame


def test_trees_predict_finite_nonnegative_and_reload(spark, fitted, tmp_path):
    model, frame = fitted
    scored = model.predict(frame)
    assert scored.columns == [*frame.columns, "y_pred"]
    assert scored.where("y_pred IS NULL OR isnan(y_pred) OR y_pred < 0").count() == 0
    model.save(f"{tmp_path}/trees")
    again = BoostedTrees().load(spark, f"{tmp_path}/trees")
    assert again.features_ == model.features_
    pick = ["store_id", "date", "y_pred"]
    assert again.predict(frame).select(pick).exceptAll(scored.select(pick)).count() == 0


def test_importances_cover_every_feature(fitted):
    model, frame = fitted
    imp = {r["feature"]: r["value"] for r in model.feature_importance().collect()}
    assert set(imp) == set(frame.columns) - {"store_id", "date", "visitors"}
    assert sum(imp.values()) == pytest.approx(1.0)


def test_leaves_map_to_depth():
    assert BoostedTrees({"num_leaves": 31}).params["max_depth"] == 5
    assert BoostedTrees({"num_leaves": 63}).params["max_depth"] == 6


def test_tree_rollout_step_equals_predict(spark, data, fitted):
    """The packed rollout step scores a day as ``predict`` scores its full feature row."""
    model, _ = fitted
    cutoff = date(2016, 5, 20)
    history = data.visits.where(F.col("date") <= F.lit(cutoff))
    packed = rollout(model, data, history, cutoff, 1)

    class Plain(BoostedTrees):
        pack_future, step = Forecaster.pack_future, Forecaster.step

    plain = Plain(SMALL)
    plain.model, plain.features_ = model.model, model.features_
    wide = rollout(plain, data, history, cutoff, 1)
    a = {r["store_id"]: r["y_pred"] for r in packed.collect()}
    b = {r["store_id"]: r["y_pred"] for r in wide.collect()}
    assert a.keys() == b.keys() == {"a", "b", "c"}
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_rollout_ignores_rows_after_the_cutoff(spark, data, fitted):
    model, _ = fitted
    cutoff = date(2016, 4, 30)
    changed = data.visits.withColumn(
        "visitors", F.when(F.col("date") > F.lit(cutoff), 999.0).otherwise(F.col("visitors"))
    )
    a = rollout(model, data, data.visits, cutoff, 3)
    b = rollout(model, data, changed, cutoff, 3)
    assert a.count() == 9
    assert a.exceptAll(b).count() == 0


def test_hybrid_trains_on_signals_and_rolls_with_them(spark, data):
    frame = build_features(data, reference=data.visits)
    model = FusedTrees(SMALL, PandasBlock(last_plus), horizon=3, train_origins=4)
    rows = model.training_rows(frame)
    assert {"sig_point", "sig_q0", "sig_q9"} <= set(rows.columns)
    assert rows.count() > 0
    model.fit(frame)
    assert "sig_point" in model.features_
    out = rollout(model, data, data.visits, date(2016, 5, 31), 3)
    assert out.count() == 9 and out.where("y_pred < 0 OR y_pred IS NULL").count() == 0


def test_signals_index_by_step(spark):
    visits = constant(spark, "s", 5.0, 10)
    sig = window_signal(visits, date(2016, 1, 10), 3, PandasBlock(last_plus), 512)
    assert {r["step"]: r["sig_point"] for r in sig.collect()} == {1: 6.0, 2: 7.0, 3: 8.0}
    origins = [date(2016, 1, 8), date(2016, 1, 9)]
    rows = training_signal(visits, origins, 2, PandasBlock(last_plus), 512)
    assert rows.where("date = '2016-01-10'").count() == 2
    assert rows.where("origin = '2016-01-08'").agg(F.max("date")).first()[0] == date(2016, 1, 10)


def test_windows_are_trimmed_and_zero_filled(spark):
    visits = ramp(spark, 6).where("date <> '2016-01-04'")
    win = context_windows(visits, [(0, date(2016, 1, 5)), (1, date(2016, 1, 8))], 3)
    got = {r["origin"]: r["ys"] for r in win.collect()}
    assert got == {0: [12.0, 0.0, 14.0], 1: [15.0, 0.0, 0.0]}


def test_weekday_profile_matches_numpy(spark, data):
    win = context_windows(data.visits, [(0, date(2016, 5, 31))], 60)
    series = {r["store_id"]: np.array(r["ys"]) for r in win.collect()}
    out = WeekdayProfile().forecast(win.select("store_id", "ys"), 9).collect()
    for r in out:
        ys = series[r["store_id"]]
        same = [ys[i] for i in range(len(ys)) if (len(ys) - 1 - i + r["step"]) % 7 == 0]
        assert r["point"] == pytest.approx(np.mean(same))
        assert np.allclose(r["quantiles"][1:], np.quantile(same, np.arange(1, 10) / 10))


def test_each_series_is_forecast_once(spark, tmp_path):
    visits = ramp(spark, 5).unionByName(ramp(spark, 5, "twin"))
    seen = spark.sparkContext.accumulator(0)

    def counting(series, horizon):
        seen.add(len(series))
        return last_plus(series, horizon)

    store = SignalStore(f"{tmp_path}/signals", PandasBlock(counting), 2, 512)
    win = context_windows(visits, [(0, date(2016, 1, 5))], 512).select("store_id", "ys")
    assert store.signals(win).count() == 4
    assert seen.value == 1  # the twins share one series
    later = visits.unionByName(ramp(spark, 9, "third"))
    win = context_windows(later, [(0, date(2016, 1, 5))], 4).select("store_id", "ys")
    more = win.unionByName(context_windows(visits, [(0, date(2016, 1, 5))], 512).select("store_id", "ys"))
    assert store.signals(more).count() == 10
    assert seen.value == 2


def test_fold_features_equal_featurising_the_slice(spark, data):
    splits = rolling_origin_splits(date(2016, 5, 31), 2, 14, 9)
    bt = Backtest(data, splits, 14)
    train = train_rows(data.visits, splits[0])
    fresh = build_features(
        PanelData(train, data.reservations, data.stores, data.holidays), reference=train
    )
    got = bt.fold_features(splits[0])
    assert got.columns == fresh.columns
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in fresh.dtypes]
    assert got.select(rounded).exceptAll(fresh.select(rounded)).count() == 0
    assert got.count() == fresh.count()


def test_one_store_with_most_rows_gives_the_same_levels(spark):
    """Raw rows of one store dominate; its daily panel does not grow."""
    raw = spark.range(30_000).selectExpr(
        "if(id % 3 > 0, 'hot', concat('s', id % 50)) AS store_id",
        "date_add(date '2016-01-01', cast(id % 40 AS int)) AS date",
        "cast(1 AS double) AS visitors",
    )
    daily = raw.groupBy("store_id", "date").agg(F.sum("visitors").alias("visitors"))
    dense = build_features(PanelData(daily), reference=daily)
    assert dense.where("store_id = 'hot'").count() == 40
    assert dense.agg(F.sum("visitors")).first()[0] == 30_000.0


def write_csvs(root, gz=()):
    files = {
        "air_visit_data.csv": "air_store_id,visit_date,visitors\ns1,2016-01-01,5\ns1,2016-01-03,7\n",
        "air_reserve.csv": "air_store_id,visit_datetime,reserve_datetime,reserve_visitors\n"
        "s1,2016-01-01 19:00:00,2015-12-31 19:00:00,2\n",
        "hpg_reserve.csv": "hpg_store_id,visit_datetime,reserve_datetime,reserve_visitors\n"
        "h1,2016-01-01 20:00:00,2016-01-01 08:00:00,3\nhX,2016-01-01 20:00:00,2016-01-01 08:00:00,9\n",
        "air_store_info.csv": "air_store_id,air_genre_name,air_area_name,latitude,longitude\n"
        "s1,Cafe,North Ward X,1.5,2.5\n",
        "store_id_relation.csv": "air_store_id,hpg_store_id\ns1,h1\n",
        "date_info.csv": "calendar_date,day_of_week,holiday_flg\n2016-01-01,Friday,1\n",
    }
    for name, body in files.items():
        if name in gz:
            (root / f"{name}.gz").write_bytes(gzip.compress(body.encode()))
        else:
            (root / name).write_text(body)


def test_csv_source(spark, tmp_path):
    write_csvs(tmp_path, gz=("hpg_reserve.csv",))
    d = check_contract(read_csv_folder(spark, str(tmp_path)))
    assert d.visits.dtypes == [("store_id", "string"), ("date", "date"), ("visitors", "double")]
    res = {r["reserve_visitors"]: r for r in d.reservations.collect()}
    assert set(res) == {2, 3}  # the unmapped id is gone
    assert (res[2]["lead_time_days"], res[3]["lead_time_days"]) == (1.0, 0.5)
    assert res[3]["store_id"] == "s1"
    assert d.holidays.first()["is_holiday"] == 1 and d.stores.first()["lat"] == 1.5


def test_missing_tables_are_all_named(spark, tmp_path):
    write_csvs(tmp_path)
    (tmp_path / "date_info.csv").unlink()
    (tmp_path / "air_reserve.csv").unlink()
    with pytest.raises(FileNotFoundError, match=r"air_reserve.csv.*date_info.csv"):
        read_csv_folder(spark, str(tmp_path))
    with pytest.raises(ValueError, match="visits.visitors"):
        check_contract(PanelData(spark.range(1).selectExpr("'a' AS store_id", "current_date() AS date")))


def test_grids_contain_their_default():
    registry = selection.default_registry()
    assert [s.name for s in registry] == [
        "seasonal_naive", "gbt_shallow", "gbt_deep", "window_profile", "fused_trees",
    ]
    assert all(s.default in s.grid or s.grid == [{}] for s in registry)
    assert len(selection.default_registry(offline=True)) == 3
    assert len(registry[1].grid) == 4


def test_selection_to_forecast(spark, data, tmp_path):
    """Select, persist, read the report back, retrain and forecast."""
    folder = f"{tmp_path}/run"
    registry = [
        ModelSpec("seasonal_naive", SeasonalNaive),
        ModelSpec("gbt", BoostedTrees, SMALL, [SMALL], True),
    ]
    settings = Settings(horizon_days=3, final_horizon_days=4, cv_stride_days=5)
    result = deploy.find_best_model(data, registry, settings, folder, n_folds=2)
    record = sinks.read_selection(spark, f"{folder}/selection")
    assert record == result.record
    assert record["model"] in ("seasonal_naive", "gbt")
    assert set(record["holdout_metrics"]) == {"rmsle", "mae", "weighted_mae"}
    assert 0 < len(record["selected_features"]) <= 35
    runs = sinks.read_runs(spark, f"{folder}/runs")
    log = {r["name"]: r for r in runs.collect()}
    steps = {f"{p}-{m}" for p in ("step1", "step3", "report") for m in ("gbt", "seasonal_naive")}
    assert log.keys() == steps | {"step2-feature-selection", "report-summary"}
    assert log["step2-feature-selection"]["params"]["n_selected"] == str(len(record["selected_features"]))
    assert {"rmsle", "mae_spring", "rmsle_h1"} <= log["report-gbt"]["metrics"].keys()
    assert log["report-summary"]["params"]["winner"] == record["model"]
    assert log["report-summary"]["metrics"]["holdout_mae"] == record["holdout_metrics"]["mae"]
    assert runs.select("run_id").distinct().count() == 1
    tables = sinks.read_report(spark, f"{folder}/report")
    assert set(tables) == {"scores", "predictions", "errors", "holdout", "importances"}
    assert tables["scores"].count() == 4
    held = tables["holdout"]
    assert held.where("date < '2016-05-28'").count() == 0 and held.count() > 0
    deploy.retrain(data, registry, folder)
    out = deploy.batch_predict(data, registry, folder)
    assert out.count() == 9 and out.agg(F.min("date")).first()[0] == date(2016, 6, 1)
    stored = spark.read.option("header", True).csv(f"{folder}/forecasts")
    assert stored.count() == 9


def test_shared_dir_is_the_named_one(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_weekday_profile_takes_each_phase_by_place(spark):
    """No test of every value per phase; short windows fall back to all values."""
    rows = [(k, [float((i * 5 + k) % 13) for i in range(k)]) for k in (1, 3, 7, 8, 30)]
    win = spark.createDataFrame(rows, "store_id int, ys array<double>")
    out = WeekdayProfile().forecast(win, 14)
    assert "filter(" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["store_id"], r["step"]): r["point"] for r in out.collect()}
    for k, ys in rows:
        for step in range(1, 15):
            on = [v for i, v in enumerate(ys) if (k - 1 - i) % 7 == -step % 7] or ys
            assert got[k, step] == pytest.approx(sum(on) / len(on))


def test_folds_stage_selected_columns_and_share_one_exchange(spark, data):
    folds = rolling_origin_splits(date(2016, 5, 1), 3, 14)
    names = ["lag_7", "store_mean", "is_closed"]
    bt = Backtest(data, folds, 14)
    frames = [bt.fold_features(s, names) for s in folds]
    assert set(bt.frame(names).columns) == {"store_id", "date", "visitors", "lag_7", "is_closed", "dow"}
    wide = Backtest(data, folds, 14)
    for s, frame in zip(folds, frames, strict=True):
        want = wide.fold_features(s).select(*frame.columns)
        assert max(r["date"] for r in frame.collect()) <= s.train_end
        assert frame.exceptAll(want).count() == want.exceptAll(frame).count() == 0
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, value in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(c, value)
        sums = [f.groupBy().agg(F.sum("lag_7")) for f in frames]
        plan = sums[0].union(sums[1]).union(sums[2])._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert plan.count("ReusedExchange") >= 2
