"""Predictions to positions, costs, returns and equity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.functions import metrics
from barfold.functions.trading import TXN_COST, Strategy, sign_signal, txn_cost_logret
from barfold.operators import blocks
from barfold.panel import HOUR, Panel

FOLD_WINS = "fold_idx"


def finalize_predictions(
    predictions: DataFrame, keys: Sequence[str] = ("asset", "time")
) -> DataFrame:
    """One prediction per row key: where folds overlap, that of the last fold."""
    rest = [c for c in predictions.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), FOLD_WINS).alias("_row")
    return predictions.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(
        *predictions.columns
    )


def anchor_predictions(predictions: DataFrame, panel: Panel, target: str | None = None) -> DataFrame:
    """Attach the unscaled label of the same row as ``actual``."""
    target = target or panel.label_cols[0]
    truth = panel.df.select(*panel.keys, F.col(target).alias("actual"))
    return predictions.join(truth, panel.keys, "left")


def realized_returns(panel: Panel, *, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """``actual = ln(P_{t+1}/P_t)`` for every bar; missing on the last one."""
    close = panel.ohlcv["close"]
    slim = panel.with_positions().select(*panel.keys, close, blocks.POS)
    cut = blocks.with_halo(slim, after=1, block_rows=block_rows)
    ahead = F.lead(close).over(blocks.block_window([panel.asset]))
    rows = blocks.core_rows(cut.withColumn("_next", ahead))
    now, then = F.col(close), F.col("_next")
    actual = F.when((now > 0) & (then > 0), F.ln(then / now))
    return rows.select(*panel.keys, actual.alias("actual"))


def strategy_returns(
    predictions: DataFrame,
    market: DataFrame,
    strategy: Strategy = sign_signal,
    *,
    keys: Sequence[str] = ("asset", "time"),
    market_return: str = "market_return",
) -> DataFrame:
    """Signal times market return on every market row; no signal counts as flat,
    rows without a market return are dropped."""
    signals = predictions.select(*keys, strategy(F.col("prediction")).alias("_signal"))
    joined = market.join(signals, list(keys), "left")
    value = F.coalesce("_signal", F.lit(0.0)) * F.col(market_return)
    return (
        joined.withColumn("strategy_return", value)
        .filter(F.col("strategy_return").isNotNull())
        .select(*keys, "strategy_return")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    out: str,
    position: Column,
    *,
    reach: int | None,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """``column`` of the preceding row, 0 on the first.

    With ``reach`` only a row at most that many positions back counts (1 for
    gap-free rows), after a wider hole the value is 0, and one shuffle does. ``None``
    looks back any distance and reads the input twice.
    """
    placed = df.withColumn(blocks.POS, position)
    if reach is None:
        done = blocks.previous(
            placed, keys, {"_before": F.struct(F.col(column).alias("v"))}, block_rows=block_rows
        )
        first = F.col("_before").isNull()
        value = F.when(first, F.lit(0.0)).otherwise(F.col("_before.v"))
        return done.withColumn(out, value).drop("_before", blocks.POS)
    cut = blocks.with_halo(placed, before=reach, block_rows=max(block_rows, reach))
    inside = blocks.block_window(keys)
    near = F.col(blocks.POS) - F.lag(blocks.POS).over(inside) <= reach
    lagged = F.when(near, F.lag(column).over(inside)).otherwise(F.lit(0.0))
    return blocks.core_rows(cut.withColumn(out, lagged)).drop(blocks.POS)


def backtest(
    predictions: DataFrame,
    panel: Panel,
    strategy: Strategy = sign_signal,
    *,
    txn_cost: float = TXN_COST,
    keys: Sequence[str] = ("asset",),
    reach: int | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    grid_seconds: int = HOUR,
) -> DataFrame:
    """Row-wise backtest of ``prediction`` against the realised one-step return.

    ``keys`` name a series of predictions and include the asset; runs of many
    models are backtested at once with ``("asset", "model", "seed")``.
    """
    time = panel.time
    actual = realized_returns(panel, block_rows=block_rows)
    rows = predictions.select(*keys, time, F.col("prediction").alias("predicted")).join(
        actual, panel.keys, "left"
    )
    signalled = rows.withColumn("signal", strategy(F.col("predicted")))
    moved = previous_value(
        signalled, keys, "signal", "prev_signal", blocks.grid_position(time, grid_seconds),
        reach=reach, block_rows=block_rows,
    )
    gross = F.col("signal") * F.col("actual")
    cost = txn_cost_logret(txn_cost, F.col("signal") - F.col("prev_signal"))
    return moved.withColumns({"gross_log_return": gross, "txn_cost": cost}).withColumn(
        "net_log_return", F.col("gross_log_return") + F.col("txn_cost")
    ).select(
        *keys, time, "predicted", "actual", "signal", "prev_signal", "gross_log_return",
        "txn_cost", "net_log_return",
    )


def equity_curve(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    value: str = "net_log_return",
    time: str = "time",
    out: str = "equity",
    grid_seconds: int = HOUR,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """``exp`` of the running sum of log returns; missing where the row's is missing,
    which does not reset the sum."""
    placed = rows.withColumn(blocks.POS, blocks.grid_position(time, grid_seconds))
    summed = blocks.running(placed, keys, {"_sum": ("sum", value)}, block_rows=block_rows)
    curve = F.when(F.col(value).isNotNull(), F.exp("_sum"))
    return summed.withColumn(out, curve).drop("_sum", blocks.POS)


def simple_returns(rows: DataFrame) -> DataFrame:
    """Simple returns of the strategy and of the market, row by row."""
    return rows.withColumns(
        {
            "strategy_return": F.expm1("net_log_return"),
            "market_return": F.expm1("actual"),
        }
    )


def backtest_metrics(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    annual_factor: int,
    time: str = "time",
    grid_seconds: int = HOUR,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Metrics of the net returns of a backtest, per series."""
    returns = simple_returns(rows)
    return metrics.compute_all(
        returns, keys, "strategy_return", blocks.grid_position(time, grid_seconds),
        annual_factor=annual_factor, block_rows=block_rows,
    )
