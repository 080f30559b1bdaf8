"""Bookings as they stood at a cutoff, the signal store in use, correlations and the input contract."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import ramp
from pyspark.sql import functions as F

from panelcast.models.hybrid import FusedTrees
from panelcast.models.naive import SeasonalNaive
from panelcast.models.window import PandasBlock
from panelcast.operators import bookings, panel, profile
from panelcast.operators.splits import rolling_origin_splits, train_rows
from panelcast.plans import rollout, selection
from panelcast.plans.backtest import Backtest
from panelcast.plans.features import build_features
from panelcast.plans.signals import SignalStore
from panelcast.plans.windows import context_windows
from panelcast.schema import DATE, KEYS, STORE, TARGET, PanelData, Settings

LAST = date(2016, 5, 31)


@pytest.fixture(scope="module")
def single(spark):
    """Single bookings of every third day, made ten to minus two days ahead of the visit."""
    rows = []
    for n in range(152):
        for store in ("a", "b"):
            for k, ahead in enumerate((10, 3, 0, -2)):
                if (n + k) % 3 == 0:
                    day = date(2016, 1, 1) + timedelta(days=n)
                    made = datetime.combine(day, datetime.min.time()) - timedelta(days=ahead) + timedelta(hours=15)
                    rows.append((store, day, 2 + k, float(ahead), made))
    return spark.createDataFrame(
        rows, "store_id string, visit_date date, reserve_visitors bigint, lead_time_days double, reserve_ts timestamp"
    )


def _plain(single, cutoff):
    end = datetime.combine(cutoff, datetime.max.time())
    frame = single.toPandas()
    kept = frame[frame.reserve_ts <= pd.Timestamp(end)]
    return kept.groupby(["store_id", "visit_date"]).reserve_visitors.agg(["sum", "count"]).to_dict("index")


def test_known_bookings_equal_a_plain_filter(spark, single):
    folds = rolling_origin_splits(LAST, 5, 14, 9)
    cube = bookings.booking_cube(single)
    got = bookings.known_bookings(cube, folds).collect()
    for s in folds:
        want = {k: v for k, v in _plain(single, s.train_end).items() if s.valid_start <= k[1] <= s.valid_end}
        mine = {(r[STORE], r[DATE]): r for r in got if r["fold"] == s.fold}
        assert mine.keys() == want.keys()
        assert all((r["reserve_visitors"], r["reserve_count"]) == (want[k]["sum"], want[k]["count"]) for k, r in mine.items())
    whole = bookings.daily_bookings(single).orderBy(*KEYS).collect()
    assert bookings.daily_bookings(cube).select(*bookings.daily_bookings(single).columns).orderBy(*KEYS).collect() == whole
    with pytest.raises(ValueError, match="single bookings"):
        bookings.booking_cube(bookings.daily_bookings(single))


def test_backtest_sees_bookings_known_at_each_cutoff(spark, data, single):
    data = replace(data, reservations=single)
    folds = rolling_origin_splits(LAST, 2, 14, 9)
    bt = Backtest(data, folds, 14, bookings_as_of=True)
    for s in folds:
        train = train_rows(data.visits, s)
        end = datetime.combine(s.train_end, datetime.max.time())
        fresh = build_features(replace(data, visits=train), reference=train, as_of=end)
        got = bt.fold_features(s)
        assert got.columns == fresh.columns
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in fresh.dtypes]
        assert got.select(rounded).exceptAll(fresh.select(rounded)).count() == 0 and got.count() == fresh.count()


class _Bookings(SeasonalNaive):
    """Forecasts the day's booked guests, rolled out day by day."""

    def forecast_folds(self, visits, splits, horizon):
        return None

    def predict(self, features):
        return features.withColumn("y_pred", F.col("reserve_visitors"))


def test_backtest_forecasts_from_bookings_known_at_each_cutoff(spark, data, single):
    data = replace(data, reservations=single)
    folds = rolling_origin_splits(LAST, 2, 14, 9)
    spec = selection.ModelSpec("bookings", lambda p: _Bookings())
    for as_of in (True, False):
        preds = Backtest(data, folds, 14, bookings_as_of=as_of).predictions(spec).collect()
        assert preds
        for r in preds:
            cutoff = folds[r["fold"]].train_end if as_of else date(2099, 1, 1)
            known = _plain(single, cutoff).get((r[STORE], r[DATE]), {"sum": 0})
            assert r["y_pred"] == known["sum"]


def test_selection_takes_the_cutoff_from_the_settings(spark, data, single):
    data = replace(data, reservations=single)
    naive = [selection.ModelSpec("seasonal_naive", SeasonalNaive)]
    settings = Settings(final_horizon_days=14, bookings_as_of=True)
    result = selection.ModelSelection(naive, settings).run(data, n_folds=1)
    assert result.record["model"] == "seasonal_naive" and result.holdout.count() > 0


def _repeats_last(count=None):
    """A forecaster that repeats the last value; a nested function, so that it travels by value."""

    def forecast(series, horizon):
        if count is not None:
            count.add(len(series))
        point = np.array([[s[-1]] * horizon for s in series], float)
        return point, np.repeat(point[:, :, None], 10, axis=2)

    return forecast


def test_fused_trees_forecast_nothing_on_the_second_fit(spark, data, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    frame = build_features(data, reference=data.visits)
    params = {"n_estimators": 1, "max_depth": 2, "subsample": 1.0, "colsample": 1.0}

    def model():
        return FusedTrees(params, PandasBlock(_repeats_last(seen)), 7, 28, 4, store_path=f"{tmp_path}/signals")

    first = model().fit(frame)
    after = seen.value
    assert after >= 12
    again = model().fit(frame)
    assert seen.value == after
    out = [rollout.rollout(m, data, data.visits, LAST, 7).orderBy(*KEYS).collect() for m in (first, again)]
    assert len(out[0]) == 21 and [r["y_pred"] for r in out[0]] == pytest.approx([r["y_pred"] for r in out[1]])


def test_two_fits_at_once_leave_each_series_once(spark, tmp_path):
    visits = ramp(spark, 40).unionByName(ramp(spark, 30, "t"))
    store = SignalStore(f"{tmp_path}/signals", PandasBlock(_repeats_last()), 3, 16)
    assert store.table(spark).count() == 0

    def ask(shift):
        origins = [(k, date(2016, 1, 20) + timedelta(days=k + shift)) for k in range(6)]
        return store.signals(context_windows(visits, origins, 16).select("origin", STORE, "ys")).count()

    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(ask, (0, 2)))
    assert counts == [36, 36]
    rows = store.table(spark)
    assert rows.count() == rows.select("series_key", "step").distinct().count() >= 24


def test_correlation_matrix_equals_pandas(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 5))
    x[:, 1] += x[:, 0]
    x[:, 4] = 3.0
    frame = pd.DataFrame(x, columns=list("abcde")).mask(draw.random((400, 5)) < 0.1)
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    want = frame.corr()
    out = profile.correlation_matrix(df, list("abcde")).collect()
    assert len(out) == 10
    for r in out:
        both = frame[[r["left"], r["right"]]].dropna()
        assert r["n"] == len(both)
        if "e" in (r["left"], r["right"]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[r["left"], r["right"]])


def test_matrix_has_every_day(spark):
    visits = ramp(spark, 5).unionByName(ramp(spark, 3, "t", start=date(2016, 1, 20)))
    wide = panel.demand_matrix(panel.densify(visits), ["s", "t"]).orderBy(DATE).collect()
    assert [r[DATE] for r in wide] == [date(2016, 1, 1) + timedelta(days=i) for i in range(22)]
    assert wide[10].asDict() == {DATE: date(2016, 1, 11), "s": None, "t": None}


def test_entry_points_reject_inputs_without_their_columns(spark, data):
    broken = PanelData(data.visits.drop(TARGET), data.reservations, data.stores.drop(STORE), data.holidays)
    with pytest.raises(ValueError, match=r"visits\.visitors.*stores\.store_id"):
        selection.ModelSelection([], Settings()).run(broken)
    with pytest.raises(ValueError, match=r"visits\.visitors"):
        selection.fit_on_all(selection.ModelSpec("n", SeasonalNaive), {}, broken, None)
