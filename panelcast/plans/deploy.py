"""The nightly and weekly batch jobs around a selected model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.base import Forecaster
from panelcast.models.naive import naive_rollout
from panelcast.operators.panel import last_day
from panelcast.operators.splits import Split
from panelcast.plans.backtest import ModelSpec
from panelcast.plans.rollout import rollout
from panelcast.plans.selection import ModelSelection, SelectionResult, fit_on_all
from panelcast.schema import DATE, STORE, PanelData, Settings
from panelcast.sources import sinks
from panelcast.sources.tables import check_contract


def find_best_model(
    data: PanelData,
    registry: list[ModelSpec],
    settings: Settings,
    folder: str,
    metric: str | None = None,
    horizon: int | None = None,
    n_folds: int | None = None,
) -> SelectionResult:
    """Select, then persist record, winner, report tables and the run log under ``folder``."""
    spark = data.visits.sparkSession
    selection = ModelSelection(registry, settings, runs_path=f"{folder}/runs")
    result = selection.run(data, metric, horizon, n_folds)
    result.winner.save(f"{folder}/best_model")
    sinks.write_selection(spark, result.record, f"{folder}/selection")
    sinks.write_report(result, f"{folder}/report")
    sinks.write_breakdowns(result.cube, f"{folder}/breakdowns")
    return result


# Evaluating is the same comparison.
evaluate = find_best_model


def retrain(data: PanelData, registry: list[ModelSpec], folder: str) -> Forecaster:
    """Refit the selected configuration on all current data and replace the saved model."""
    spark = data.visits.sparkSession
    record = sinks.read_selection(spark, f"{folder}/selection")
    spec = {s.name: s for s in registry}[record["model"]]
    model = fit_on_all(spec, record["params"], data, record["selected_features"])
    model.save(f"{folder}/best_model")
    sinks.append_runs(
        spark,
        f"{folder}/runs",
        f"retrain-{uuid.uuid4().hex}",
        [
            (
                f"train-{record['model']}",
                {"model": record["model"], **{f"param_{k}": v for k, v in record["params"].items()}},
                {"retrained_on_rows": data.visits.count()},
            )
        ],
    )
    return model


def batch_predict(
    data: PanelData, registry: list[ModelSpec], folder: str, horizon: int | None = None
) -> DataFrame:
    """The next days of every store from the saved model, written in (store, date) order."""
    spark = data.visits.sparkSession
    record = sinks.read_selection(spark, f"{folder}/selection")
    spec = {s.name: s for s in registry}[record["model"]]
    model = spec.factory(record["params"]).load(spark, f"{folder}/best_model")
    cutoff = last_day(check_contract(data).visits)
    forecasts = rollout(model, data, data.visits, cutoff, horizon or record["horizon"])
    sinks.write_forecasts(forecasts, f"{folder}/forecasts")
    return forecasts


def predict_naive(visits: DataFrame, horizon: int) -> DataFrame:
    """Seasonal-naive batch forecast after the last day, all stores in one plan."""
    cutoff = last_day(visits)
    split = Split(0, cutoff, cutoff, cutoff)
    return naive_rollout(visits, [split], horizon).select(STORE, DATE, F.col("y_pred"))
