from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import PANEL, ramp
from pyspark.sql import functions as F

from panelcast.operators import profile
from panelcast.operators.bookings import add_bookings, daily_bookings, daily_bookings_from
from panelcast.operators.calendar import add_calendar, add_holidays
from panelcast.operators.entities import add_entities, store_metadata
from panelcast.operators.history import add_history, history_columns
from panelcast.operators.panel import coverage, densify, densify_to, future_scaffold, series_arrays
from panelcast.plans.features import build_features, feature_columns, subset_features
from panelcast.schema import LAGS, ROLL_WINDOWS
from panelcast.sources.tables import reservations_from


def by_day(df, *cols):
    return {r["date"]: r for r in df.collect()}


def test_history_sees_only_the_past(spark):
    rows = by_day(add_history(densify(ramp(spark, 20))))
    day = rows[date(2016, 1, 11)]
    assert (day["lag_1"], day["lag_7"], day["roll_mean_7"]) == (19.0, 13.0, 16.0)
    assert all(rows[date(2016, 1, 1) + timedelta(days=i)]["roll_mean_7"] is None for i in range(7))
    assert rows[date(2016, 1, 1)]["lag_1"] is None


def test_history_matches_pandas_on_an_irregular_panel(spark, data):
    got = add_history(densify(data.visits)).toPandas().sort_values(["store_id", "date"])
    for _, g in got.groupby("store_id"):
        past = g["visitors"].shift(1)
        for k in LAGS:
            pd.testing.assert_series_equal(g[f"lag_{k}"], g["visitors"].shift(k), check_names=False)
        for w in ROLL_WINDOWS:
            pd.testing.assert_series_equal(
                g[f"roll_mean_{w}"], past.rolling(w).mean(), check_names=False
            )
            pd.testing.assert_series_equal(
                g[f"roll_median_{w}"], past.rolling(w).median(), check_names=False
            )


def test_rollout_history_equals_training_history(spark, data):
    """The array form used while rolling out gives the window form's values."""
    dense = densify(data.visits.where("store_id = 'a'"))
    trained = add_history(dense).orderBy(F.desc("date")).first()
    hist = series_arrays(dense.where(F.col("date") < trained["date"]).orderBy("date"))
    tail = hist.select(F.slice("ys", -35, 35).alias("h"))
    row = tail.select(*[c.alias(n) for n, c in history_columns(F.col("h")).items()]).first()
    for name in row.asDict():
        assert row[name] == pytest.approx(trained[name])


def test_no_feature_changes_when_the_future_does(spark, data):
    cut = date(2016, 4, 1)
    changed = data.visits.withColumn(
        "visitors", F.when(F.col("date") >= F.lit(cut), 1000.0).otherwise(F.col("visitors"))
    )
    past = F.col("date") <= F.lit(cut)
    names = ["store_id", "date", *[f"lag_{k}" for k in LAGS], "roll_mean_35", "roll_median_35"]
    a = add_history(densify(data.visits)).where(past).select(names)
    b = add_history(densify(changed)).where(past).select(names)
    assert a.exceptAll(b).count() == 0


def test_gap_becomes_a_closed_zero_day(spark):
    visits = ramp(spark, 5).where("date <> '2016-01-03'")
    day = by_day(densify(visits))[date(2016, 1, 3)]
    assert (day["visitors"], day["is_closed"]) == (0.0, 1)
    assert densify(visits).count() == 5


def test_densify_variants(spark):
    visits = ramp(spark, 3).unionByName(ramp(spark, 6, "t"))
    assert densify(visits).count() == 9
    assert densify_to(visits).count() == 12
    clipped = densify(visits, since=date(2016, 1, 5), until=date(2016, 1, 7))
    assert [r["visitors"] for r in clipped.where("store_id = 't'").orderBy("date").collect()] == [
        14.0,
        15.0,
        0.0,
    ]
    assert clipped.where("store_id = 's'").count() == 3


def test_densify_refuses_duplicate_days(spark):
    twice = ramp(spark, 3).unionByName(ramp(spark, 3))
    with pytest.raises(Exception, match="one row per"):
        densify(twice).collect()


def test_side_rows_outside_the_span_are_dropped(spark):
    daily = spark.createDataFrame(
        [("s", date(2015, 12, 1), 9.0, 1), ("s", date(2016, 1, 2), 4.0, 2), ("x", date(2016, 1, 2), 1.0, 1)],
        "store_id string, date date, reserve_visitors double, reserve_count bigint",
    )
    visits = ramp(spark, 4).where("date <> '2016-01-02'")
    rows = by_day(densify(visits, daily))
    assert len(rows) == 4
    assert rows[date(2016, 1, 2)]["reserve_visitors"] == 4.0
    assert rows[date(2016, 1, 2)]["is_closed"] == 1
    assert rows[date(2016, 1, 3)]["reserve_count"] is None


def test_saturday(spark):
    day = by_day(add_calendar(ramp(spark, 3)))[date(2016, 1, 2)]
    assert (day["dow"], day["is_weekend"]) == (5, 1)


def test_holiday_neighbours_are_calendar_rows(spark, data):
    rows = by_day(add_holidays(ramp(spark, 12), data.holidays))
    assert rows[date(2016, 1, 1)]["day_before_holiday"] == 1  # next row of the table is a holiday
    assert rows[date(2016, 1, 11)]["day_after_holiday"] == 1
    assert rows[date(2016, 1, 5)]["is_holiday"] == 0
    golden = by_day(add_holidays(ramp(spark, 130)))
    assert [golden[date(2016, m, d)]["golden_week"] for m, d in ((4, 28), (4, 29), (5, 5), (5, 6))] == [
        0, 1, 1, 0,
    ]


def test_bookings_sum_count_and_default(spark):
    visits = ramp(spark, 3)
    booked = spark.createDataFrame(
        [("s", date(2016, 1, 2), 3, 1.0), ("s", date(2016, 1, 2), 4, 2.0)],
        "store_id string, visit_date date, reserve_visitors bigint, lead_time_days double",
    )
    rows = by_day(add_bookings(visits, booked))
    day = rows[date(2016, 1, 2)]
    assert (day["reserve_visitors"], day["reserve_count"], day["reserve_lead_time_mean"]) == (7, 2, 1.5)
    assert rows[date(2016, 1, 1)]["reserve_visitors"] == 0.0
    assert "reserve_lead_time_mean" not in add_bookings(visits, None).columns


def test_preaggregated_bookings_equal_the_row_level_union(spark):
    """One foreign id holds most rows; both paths agree."""
    direct = spark.range(300).selectExpr(
        "concat('s', id % 3) AS store_id", "timestamp '2016-01-02 18:30:00' AS visit_datetime",
        "timestamp '2016-01-01 12:00:00' AS reserve_datetime", "id % 5 AS reserve_visitors",
    )
    mapped = spark.range(600).selectExpr(
        "if(id % 3 = 0, id % 7, 99) AS hpg_store_id", "timestamp '2016-01-02 19:00:00' AS visit_datetime",
        "timestampadd(HOUR, -cast(id % 30 AS int), timestamp '2016-01-02 19:00:00') AS reserve_datetime",
        "id % 4 AS reserve_visitors",
    )
    relation = spark.createDataFrame(
        [("s0", 99), ("s1", 1), ("s2", 2)], "store_id string, hpg_store_id bigint"
    )
    rows = daily_bookings(reservations_from(direct, mapped, relation))
    fast = daily_bookings_from(direct, mapped, relation)

    def table(df):
        return {
            (r["store_id"], r["date"]): (
                r["reserve_visitors"], r["reserve_count"], round(r["reserve_lead_time_mean"], 9)
            )
            for r in df.collect()
        }

    assert table(rows) == table(fast)


def test_levels_come_from_the_reference_only(spark):
    visits = ramp(spark, 6, first=10.0)
    frame = add_calendar(visits)
    reference = visits.where("date <= '2016-01-03'")
    spiked = reference.unionByName(ramp(spark, 1, "other", 1000.0))
    row = add_entities(frame, spiked).where("date = '2016-01-06'").first()
    assert (row["store_mean"], row["store_median"]) == (11.0, 11.0)
    assert row["store_dow_mean"] is None  # that weekday is not in the reference


def test_metadata_is_unique_and_splits_the_area(spark):
    stores = spark.createDataFrame(
        [("a", "x", "P W rest of it"), ("a", "w", "Q"), ("b", "y", None)],
        "store_id string, genre string, area string",
    )
    rows = {r["store_id"]: r for r in store_metadata(stores).collect()}
    assert (rows["a"]["genre"], rows["a"]["area_prefecture"], rows["a"]["area_ward"]) == ("w", "Q", None)
    assert rows["b"]["area_prefecture"] is None


def test_feature_matrix_shape_and_subset(spark, data):
    df = build_features(data, reference=data.visits)
    assert len(df.columns) == 38
    assert df.columns[:4] == ["store_id", "date", "visitors", "is_closed"]
    assert len(feature_columns(df)) == 35
    assert df.count() == 3 * 152
    assert subset_features(df, ["lag_7", "dow"]).columns == [
        "store_id", "date", "visitors", "dow", "lag_7",
    ]
    assert subset_features(df, None) is df


def test_dense_rows_are_never_exchanged(spark, data):
    """Only sparse inputs and per-store levels are shuffled; no cross join, no Python."""
    df = build_features(data, reference=data.visits)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan
    spine = plan[: plan.index("Generate")]  # all that runs after the calendar is filled in
    assert "Window" in spine and "Exchange" not in spine


def test_scaffold_and_coverage(spark):
    visits = ramp(spark, 4).where("date <> '2016-01-02'")
    rows = future_scaffold(visits, date(2016, 1, 4), 3).collect()
    assert sorted(r["date"].day for r in rows) == [5, 6, 7]
    cov = coverage(visits).first()
    assert (cov["present_days"], cov["span_days"], cov["missing_days"]) == (3, 4, 1)


def test_null_target_counts_as_closed(spark):
    visits = spark.createDataFrame([("s", date(2016, 1, 1), None), ("s", date(2016, 1, 2), 3.0)], PANEL)
    rows = by_day(densify(visits))
    assert rows[date(2016, 1, 1)]["is_closed"] == 1 and rows[date(2016, 1, 1)]["visitors"] == 0.0


def test_means_over_multiples_share_one_sliding_sum(spark, data):
    dense = densify(data.visits)
    widths = (3, 6, 7, 12)
    made = add_history(dense, lags=(1,), windows=widths)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in plan
    assert [w for w in widths if f"-{w}, -1)" in plan] == [3, 7, 12]  # 12 days are gathered for the medians
    got = made.toPandas().sort_values(["store_id", "date"])
    by_store = got.groupby("store_id")["visitors"]
    for w in widths:
        want = by_store.transform(lambda s, w=w: s.shift(1).rolling(w).mean())
        np.testing.assert_allclose(got[f"roll_mean_{w}"].astype(float), want, rtol=1e-12)
        middle = by_store.transform(lambda s, w=w: s.shift(1).rolling(w).median())
        np.testing.assert_allclose(got[f"roll_median_{w}"].astype(float), middle, rtol=1e-12)


def test_correlations_are_merged_from_parts(spark):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame({"a": 1e6 + rng.normal(size=n), "b": rng.normal(size=n), "c": rng.integers(0, 9, n).astype(float)})
    frame["b"] += 0.5 * (frame["a"] - 1e6)
    frame.loc[rng.random(n) < 0.2, "b"] = np.nan
    frame.loc[rng.random(n) < 0.1, "c"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    found = profile.correlation_pairs(df, ["a", "b", "c"])
    assert "corr(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.left, r.right): r["corr"] for r in found.collect()}
    want = frame.corr()
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (left, right), value in got.items():
        assert value == pytest.approx(want.loc[left, right], abs=1e-9)
    assert [r["corr"] for r in profile.correlation_pairs(df.limit(0), ["a", "b", "c"]).collect()] == [None] * 3
    single = profile.correlation_with(df.limit(1), "c", ["a"]).collect()
    assert [(r.feature, r["corr"]) for r in single] == [("a", None)]
