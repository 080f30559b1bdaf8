"""Fold levels are added up where a store's days lie."""

from datetime import date

from panelcast.operators.splits import fold_levels, rolling_origin_splits


def test_levels_exchange_only_the_days(spark, panel_rows):
    visits = spark.createDataFrame(panel_rows, "store_id string, date date, visitors double")
    levels = fold_levels(visits, rolling_origin_splits(date(2016, 5, 20), 3, 7))
    assert levels._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_levels_of_folds_without_new_days(spark):
    rows = [("a", date(2016, 5, 1), 3.0), ("a", date(2016, 5, 2), None), ("b", date(2016, 5, 15), 4.0), (None, date(2016, 5, 1), 1.0)]
    visits = spark.createDataFrame(rows, "store_id string, date date, visitors double")
    splits = rolling_origin_splits(date(2016, 5, 30), 3, 7)
    got = sorted((r.fold, str(r.store_id), r.total, r.store_mean, str(r.last_day)) for r in fold_levels(visits, splits).collect())
    want = [(f, s, v, v, d) for f in range(3) for s, v, d in (("None", 1.0, "2016-05-01"), ("a", 3.0, "2016-05-02"), ("b", 4.0, "2016-05-15"))]
    assert [s.train_end for s in splits] == [date(2016, 5, 9), date(2016, 5, 16), date(2016, 5, 23)]
    assert got == [w for w in want if w[0] > 0 or w[1] != "b"]
