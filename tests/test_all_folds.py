"""All folds' training frames in one plan, and fits on merged rows."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelcast import session
from panelcast.catalog import queries
from panelcast.models.base import merge_rows
from panelcast.models.trees import BoostedTrees
from panelcast.operators.bookings import daily_bookings
from panelcast.operators.splits import last_days, rolling_origin_splits
from panelcast.plans.backtest import Backtest, ModelSpec
from panelcast.sources import bindings

STUMP = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, "subsample": 1.0, "colsample": 1.0}
SPLITS = rolling_origin_splits(date(2016, 5, 31), 3, 7, 9)


def _rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("selected", [None, ["lag_7", "store_dow_median"], ["is_closed"], ["store_mean", "genre"]])
def test_all_folds_hold_the_frame_of_each(data, selected):
    bt = Backtest(data, SPLITS, 7)
    whole = session.stage(bt.all_fold_features(selected), "all-folds")
    for split in SPLITS:
        own = whole.where(F.col("fold") == split.fold).drop("fold")
        expected = bt.fold_features(split, selected)
        assert own.columns == expected.columns
        assert _rows(own) == _rows(expected)


def test_a_store_unknown_to_a_fold_has_no_last_day_in_it(spark):
    visits = spark.createDataFrame(
        [("old", date(2016, 1, 1), 1.0), ("new", SPLITS[1].train_end, 2.0)], "store_id string, date date, visitors double"
    )
    found = {r["store_id"]: [tuple(f) for f in r["_folds"]] for r in last_days(visits, SPLITS).collect()}
    assert found["old"] == [(k, date(2016, 1, 1)) for k in range(3)]
    assert found["new"] == [(k, SPLITS[1].train_end) for k in (1, 2)]


def test_equal_rows_are_merged_before_a_fit_that_draws_nothing(spark, monkeypatch):
    rows = [("s", date(2016, 1, 1), float(v), c) for v, c in [(0, 1), (0, 1), (4, 0), (4, 0), (4, 0), (9, 0)]]
    frame = spark.createDataFrame(rows, "store_id string, date date, visitors double, is_closed int")
    written = []
    monkeypatch.setattr("panelcast.models.trees.stage", lambda df, label: written.append(session.stage(df, label)) or written[-1])
    whole = BoostedTrees(STUMP).fit(frame)
    merged = BoostedTrees(STUMP).fit(merge_rows(frame, ["is_closed"]))
    assert [w.count() for w in written] == [3, 3]
    assert sorted(r["_weight"] for r in written[0].collect()) == [1.0, 2.0, 3.0]
    wide = [{r["is_closed"]: r["y_pred"] for r in m.predict(frame).collect()} for m in (whole, merged)]
    log_mean = (3 * F.log1p(F.lit(4.0)) + F.log1p(F.lit(9.0))) / 4
    expected = spark.range(1).select(F.expm1(log_mean)).first()[0]
    assert wide[0] == pytest.approx({1: 0.0, 0: expected}) and wide[1] == pytest.approx(wide[0])


def test_text_and_drawn_rows_are_never_merged():
    assert BoostedTrees(STUMP).merges({"is_closed": "int"})
    assert not BoostedTrees(STUMP).merges({"genre": "string"})
    assert not BoostedTrees({**STUMP, "subsample": 0.8}).merges({"is_closed": "int"})


def test_folds_share_one_table_of_merged_rows(data, monkeypatch):
    bt = Backtest(data, SPLITS, 7)
    monkeypatch.setattr(bt, "fold_features", lambda *a: pytest.fail("read fold by fold"))
    spec = ModelSpec("stump", BoostedTrees, STUMP, is_tree=True)
    assert bt.predictions(spec, selected=["is_closed"]).count() > 0


def test_trees_read_visits_and_bookings_from_tables(spark, data, monkeypatch):
    summed = data.visits.groupBy("store_id", "date").agg(F.sum("visitors").alias("visitors"))
    loaded = replace(data, visits=summed, reservations=daily_bookings(data.reservations))
    monkeypatch.setattr(bindings, "load", lambda spark, d: loaded)
    read = queries._tree_frame(spark, "")[0]
    for got, want in ((read.visits, summed), (read.reservations, loaded.reservations)):
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert _rows(got) == _rows(want)
