from datetime import date, timedelta

import numpy as np
import pytest
from conftest import PANEL
from pyspark.sql import functions as F

from panelcast.functions import metrics, scalar
from panelcast.operators import profile, ranking, report
from panelcast.operators.quantiles import exact_quantiles, histogram
from panelcast.operators.splits import (
    final_holdout,
    fold_levels,
    fold_profiles,
    rolling_origin_splits,
    trailing_rows,
    valid_rows,
)

LAST = date(2017, 4, 22)
PREDS = "store_id string, date date, y_pred double, y_true double, horizon_offset int"


def test_holdout_bounds():
    s = final_holdout(LAST, 39)
    assert (s.valid_start, s.valid_end, s.train_end) == (date(2017, 3, 15), LAST, date(2017, 3, 14))


def test_splits_are_ordered_and_tile_by_default():
    splits = rolling_origin_splits(LAST, 3, 14)
    assert [s.fold for s in splits] == [0, 1, 2]
    for a, b in zip(splits, splits[1:], strict=False):
        assert b.valid_start == a.valid_end + timedelta(days=1)
    assert rolling_origin_splits(LAST, 3, 14, 0) == splits


def test_stride_overlaps():
    a, b = rolling_origin_splits(LAST, 2, 14, 9)
    assert (b.train_end - a.train_end).days == 9 and b.valid_start <= a.valid_end


def test_rows_fall_into_every_fold_that_wants_them(spark):
    days = [("s", LAST - timedelta(days=i), 1.0) for i in range(60)]
    panel = spark.createDataFrame(days, PANEL)
    splits = rolling_origin_splits(LAST, 3, 14, 9)
    assert valid_rows(panel, splits).groupBy("fold").count().where("count <> 14").count() == 0
    got = {r["fold"]: r["count"] for r in trailing_rows(panel, splits, 9).groupBy("fold").count().collect()}
    assert got == {0: 10, 1: 10, 2: 10}


def test_fold_levels_equal_slicing(spark, data, panel_rows):
    splits = rolling_origin_splits(date(2016, 5, 31), 4, 14, 9)
    wide = {(r["fold"], r["store_id"]): r for r in fold_profiles(data.visits, splits).collect()}
    light = {(r["fold"], r["store_id"]): r for r in fold_levels(data.visits, splits).collect()}
    for s in splits:
        for store in "abc":
            rows = [(d, v) for st, d, v in panel_rows if st == store and d <= s.train_end]
            got, less = wide[s.fold, store], light[s.fold, store]
            values = [v for _, v in rows]
            assert got["store_mean"] == pytest.approx(np.mean(values))
            assert less["store_mean"] == pytest.approx(np.mean(values))
            assert got["store_median"] == np.median(values)
            assert got["last_day"] == less["last_day"] == rows[-1][0]
            for wd in range(7):
                on = [v for d, v in rows if d.weekday() == wd]
                assert got["_dow_median"][wd] == np.median(on)
                assert got["_dow_mean"][wd] == pytest.approx(np.mean(on))


def one(spark, y_true, y_pred):
    return spark.createDataFrame(
        [(float(t), float(p)) for t, p in zip(y_true, y_pred, strict=True)],
        "y_true double, y_pred double",
    )


def test_metrics(spark):
    perfect = one(spark, [1, 2, 3], [1, 2, 3]).agg(*metrics.suite()).first()
    assert list(perfect) == [0.0, 0.0, 0.0]
    clipped = one(spark, [0, 0], [-5, -1]).agg(*metrics.suite()).first()
    assert list(clipped) == [0.0, 0.0, 0.0]
    w = {"under_weight": 2.0, "over_weight": 1.0}
    assert one(spark, [10], [8]).agg(metrics.weighted_mae(**w)).first()[0] == 4.0
    assert one(spark, [10], [12]).agg(metrics.weighted_mae(**w)).first()[0] == 2.0


def test_metric_resolver(spark):
    df = one(spark, [10], [8])
    assert df.agg(metrics.selection_metric("mae")).first()[0] == 2.0
    assert df.agg(metrics.selection_metric("weighted_mae", 3.0, 1.0)).first()[0] == 6.0
    with pytest.raises(ValueError, match="unknown"):
        metrics.selection_metric("r2")


def test_seasons_and_regions(spark):
    months = spark.range(1, 13).select(
        scalar.season(F.make_date(F.lit(2016), F.col("id").cast("int"), F.lit(1))).alias("s")
    )
    assert [r["s"] for r in months.collect()] == (
        ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]
    )
    areas = spark.createDataFrame([("  Tokyo\tWard",), ("Osaka",), ("",), (None,)], "area string")
    assert [r[0] for r in areas.select(scalar.region(F.col("area"))).collect()] == [
        "Tokyo", "Osaka", None, None,
    ]


def test_reports(spark):
    rows = [
        ("a" if k % 2 else "z", date(2016, m, 1), 10.0 + k, 10.0, k)
        for m in (1, 4, 7, 10)
        for k in (1, 2, 3)
    ]
    preds = spark.createDataFrame(rows, PREDS).withColumn("model", F.lit("m"))
    stores = spark.createDataFrame([("a", "North X")], "store_id string, area string")
    cube = report.error_cube(preds, stores)
    table = {(r["scope"], r["key"]): r for r in cube.collect()}
    assert table["overall", "all"]["n"] == 12
    assert {k for s, k in table if s == "season"} == {"winter", "spring", "summer", "autumn"}
    assert {k for s, k in table if s == "region"} == {"North", "unknown"}
    assert table["horizon", "3"]["mae"] == 3.0
    flat = {r["metric"] for r in report.metric_rows(cube).collect()}
    assert "rmsle_h2" in flat and "mae_winter" in flat and "mae_h2" not in flat
    assert not any("North" in m for m in flat)


def test_fold_scores_average_per_fold(spark):
    rows = [(0, 10.0, 10.0)] * 9 + [(1, 10.0, 14.0)]
    preds = spark.createDataFrame(rows, "fold int, y_true double, y_pred double").withColumn(
        "model", F.lit("m")
    )
    score = report.cv_scores(preds, "model").first()
    assert (score["mae"], score["n_folds"]) == (2.0, 2)
    names = spark.createDataFrame([("m",), ("absent",)], "model string")
    all_scores = {r["model"]: r["mae"] for r in report.scored_or_inf(names, report.cv_scores(preds, "model")).collect()}
    assert all_scores == {"m": 2.0, "absent": float("inf")}


def test_selection_by_share(spark):
    imp = spark.createDataFrame(
        [("a", 50.0), ("b", 30.0), ("c", 20.0), ("d", 0.0), ("e", -1.0)], "feature string, value double"
    )

    def kept(threshold):
        return [r["feature"] for r in ranking.select_by_share(imp, threshold).orderBy("rank").collect()]

    assert kept(0.5) == ["a"]
    assert kept(0.8) == ["a", "b"]
    assert kept(1.5) == ["a", "b", "c"]
    top = ranking.importance_topk(imp.where("value >= 0"), 2).collect()
    assert [round(r["share_pct"]) for r in top] == [50, 30]
    zero = spark.createDataFrame([("a", 0.0)], "feature string, value double")
    assert ranking.importance_shares(zero).first()["share_pct"] == 0.0


def test_best_configuration_breaks_ties_by_order(spark):
    rows = [("x", 0, 2.0), ("x", 1, 1.0), ("y", 2, 1.0), ("y", 3, 1.0)]
    best = ranking.best_per_model(spark.createDataFrame(rows, "model string, ordinal int, score double"))
    assert {r["model"]: r["ordinal"] for r in best.collect()} == {"x": 1, "y": 2}
    assert ranking.best_overall(best).first()["model"] == "x"


@pytest.mark.parametrize("kind", ["normal", "hot", "few"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=30_000),
        "hot": np.where(rng.random(30_000) < 0.4, 7.0, rng.normal(size=30_000)),
        "few": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.01, 0.25, 0.5, 0.99]
    # A coarse sketch makes the bracketing path do the work.
    got = exact_quantiles(df, "v", probs, accuracy=500).first()
    assert got["n"] == len(values)
    assert np.allclose(got["quantiles"], np.quantile(values, probs))


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    counts = {r["bin"]: r["n"] for r in histogram(df, "v", 5).collect()}
    assert counts == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_profile_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,)], "visitors double")
    import pandas as pd

    s = pd.Series([1.0, 2.0, 2.0, 10.0])
    d = profile.describe(df).first()
    assert (d["p25"], d["p50"], d["p75"]) == tuple(s.quantile([0.25, 0.5, 0.75]))
    assert profile.skew(df).first()["skew_raw"] == pytest.approx(s.skew())


def test_residual_histogram_uses_pooled_bounds(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x), 0.0) for x in rng.normal(size=500)] + [
        ("b", float(x), 0.0) for x in rng.normal(size=500) * 3
    ]
    preds = spark.createDataFrame(rows, "model string, y_true double, y_pred double")
    res = np.array([r[1] for r in rows])
    lo, hi = np.quantile(res, [0.01, 0.99])
    got = report.residual_histogram(preds)
    total = got.agg(F.sum("n")).first()[0]
    assert total == ((res >= lo) & (res <= hi)).sum()
