"""From bars to performance metrics in one plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from barfold.functions.trading import TXN_COST, Strategy, sign_signal
from barfold.operators import backtest, walkforward
from barfold.operators.calendar import Schedule
from barfold.operators.models import Forecaster
from barfold.panel import Panel
from barfold.session import checkpoint_root


def forecast_and_backtest(
    panel: Panel,
    schedule: Schedule,
    model: Forecaster,
    *,
    strategy: Strategy = sign_signal,
    txn_cost: float = TXN_COST,
    annual_factor: int = 8760,
    **engine,
) -> DataFrame:
    """Metrics per asset of trading the forecasts of a schedule.

    Overlapping folds are resolved first. Folds without rows leave holes, over which
    a position is carried on; the forecasts are stored, as that reads them twice.
    """
    predictions = walkforward.walk_forward(panel, schedule, model, **engine)
    if schedule.step < schedule.test:
        predictions = backtest.finalize_predictions(predictions, panel.keys)
    spark = predictions.sparkSession
    path = f"{checkpoint_root(spark)}/barfold-{uuid.uuid4().hex}"
    predictions.write.parquet(path)
    predictions = spark.read.schema(predictions.schema).parquet(path)
    rows = backtest.backtest(
        predictions, panel, strategy, txn_cost=txn_cost, keys=(panel.asset,),
        grid_seconds=schedule.seconds,
    )
    return backtest.backtest_metrics(
        rows, [panel.asset], annual_factor=annual_factor, time=panel.time,
        grid_seconds=schedule.seconds,
    )
