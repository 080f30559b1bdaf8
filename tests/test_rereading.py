"""Backtests sum the raw lines once and take no deciles that nobody reads."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from panelcast.catalog import more_queries, queries
from panelcast.models.naive import naive_rollout
from panelcast.models.window import WeekdayProfile, block_rollout
from panelcast.operators.splits import rolling_origin_splits
from panelcast.schema import DATE, STORE


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three suppliers' lines over a year and a half."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [
        (s, datetime(2016, 1, 1) + timedelta(days=n), float(1 + (n * s) % 9))
        for s in (1, 2, 3)
        for n in range(540)
        if (n * 7 + s) % 5
    ]
    lines = spark.createDataFrame(rows + rows[:50], "l_suppkey long, l_shipdate timestamp, l_quantity double")
    lines.write.parquet(f"{at}/lineitem.parquet")
    stores = [(1, 0, "one"), (2, 1, "two"), (3, 1, "three")]
    spark.createDataFrame(stores, "s_suppkey long, s_nationkey long, s_name string").write.parquet(f"{at}/supplier.parquet")
    nations = [(0, "PERU", 0), (1, "CHINA", 1)]
    spark.createDataFrame(nations, "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(0, "AMERICA"), (1, "ASIA")], "r_regionkey long, r_name string").write.parquet(f"{at}/region.parquet")
    return at


@pytest.mark.parametrize("name", ["metrics_overall", "error_by_region", "error_cube", "runs_flat", "ablation_delta"])
def test_backtest_reports_do_not_sum_the_lines_again(spark, tables, name):
    out = queries.QUERIES[name](spark, tables)
    assert "l_quantity" not in plan(out) and out.count() > 0


def test_hierarchy_does_not_sum_the_lines_again(spark, tables):
    nodes, tree = more_queries._levels(spark, tables)
    assert "l_quantity" not in plan(nodes) and "l_suppkey" not in plan(tree)
    plain = more_queries._levels(spark, tables, staged=False)
    for got, want in zip((nodes, tree), plain, strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_levels_are_computed_once(spark, panel_rows):
    visits = spark.createDataFrame(panel_rows, "store_id string, date date, visitors double")
    preds = naive_rollout(visits, rolling_origin_splits(date(2016, 5, 20), 3, 7), 7)
    assert "_dow_mean" in plan(preds) and "min(_first" not in plan(preds)


def test_points_alone_need_no_deciles(spark, panel_rows):
    visits = spark.createDataFrame(panel_rows, "store_id string, date date, visitors double")
    points = block_rollout(visits, rolling_origin_splits(date(2016, 5, 20), 3, 7), 7, WeekdayProfile(), 56)
    assert "FLOOR" not in plan(points).upper() and points.select(STORE, DATE).count() == 3 * 3 * 7


@pytest.mark.parametrize("n", [1, 5, 8, 60])
def test_points_and_deciles(spark, n):
    ys = np.random.default_rng(n).random(n).round(3)
    windows = spark.createDataFrame([(1, ys.tolist())], "store_id long, ys array<double>")
    rows = WeekdayProfile().forecast(windows, 9).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(1, 10))
    for r in rows:
        phase = -r["step"] % 7
        own = ys[::-1][phase::7] if n > phase else ys
        want = [own.mean(), *np.quantile(own, np.arange(1, 10) / 10)]
        assert r["point"] == pytest.approx(want[0]) and r["quantiles"] == pytest.approx(want)
    alone = WeekdayProfile().forecast(windows, 9).select("step", "point").orderBy("step").collect()
    assert [r["point"] for r in alone] == [r["point"] for r in rows]
