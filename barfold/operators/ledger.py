"""Recorded position decisions replayed against returns, as tables.

Rows are keyed by ``(*keys, fold_idx, step)``; a fold is one episode of
``horizon`` steps. Windows inside a fold are bounded by the horizon.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.functions import metrics
from barfold.functions.trading import TXN_COST, action_position, txn_cost_logret
from barfold.operators import blocks
from barfold.operators.backtest import previous_value
from barfold.operators.calendar import Schedule
from barfold.operators.folds import TRAIN, _memberships, fold_position
from barfold.panel import Panel


def ledger_order(horizon: int):
    """Position of a step in the sequence of all episodes."""
    return F.col("fold_idx") * horizon + F.col("step")


def replay_positions(
    actions: DataFrame,
    *,
    horizon: int,
    keys: Sequence[str] = ("asset",),
    txn_cost: float = TXN_COST,
    carry_position: bool = True,
    reach: int | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Position, cost and pnl of each step out of ``action`` and ``actual``.

    Every fold has all its steps. A fold starts from the last position of the
    fold before (``carry_position``) or from flat. ``reach=1`` states that no
    fold is missing.
    """
    placed = actions.withColumn("position", action_position(F.col("action")))
    if carry_position:
        moved = previous_value(
            placed, keys, "position", "prev_position", ledger_order(horizon),
            reach=reach, block_rows=block_rows,
        )
    else:
        episode = Window.partitionBy(*keys, "fold_idx").orderBy("step")
        moved = placed.withColumn("prev_position", F.lag("position", 1, 0.0).over(episode))
    cost = txn_cost_logret(txn_cost, F.col("position") - F.col("prev_position"))
    return moved.withColumn("txn_cost", cost).withColumn(
        "step_pnl", F.col("position") * F.col("actual") + F.col("txn_cost")
    )


def episode_cum_pnl(ledger: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Add ``cum_pnl``, the pnl of the episode up to and including the step."""
    episode = Window.partitionBy(*keys, "fold_idx").orderBy("step")
    running = episode.rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("cum_pnl", F.sum("step_pnl").over(running))


def forecast_accuracy(
    forecasts: DataFrame,
    keys: Sequence[str] = ("asset",),
    *,
    folds: int = 10,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Per fold the mean absolute error averaged over the last ``folds`` folds that
    are present before it; 0 for the first. ``forecasts`` has ``fold_idx, forecast,
    actual``."""
    error = F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae")
    per_fold = forecasts.groupBy(*keys, "fold_idx").agg(error)
    # Folds may be missing: halos are counted in folds that are there.
    ranked = blocks.rank_positions(per_fold, keys, ["fold_idx"])
    cut = blocks.with_halo(ranked, before=folds, block_rows=max(block_rows, folds))
    recent = blocks.block_window(keys).rowsBetween(-folds, -1)
    rolled = cut.withColumn(
        "forecast_accuracy", F.coalesce(F.avg("mae").over(recent), F.lit(0.0))
    )
    return blocks.core_rows(rolled).select(*keys, "fold_idx", "forecast_accuracy")


def fold_volatility(
    panel: Panel, schedule: Schedule, *, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Population std of the log returns of close inside each untrimmed training
    window; the return into the window's first row does not count. 0 below two rows.

    Moments are taken once per stretch of positions and added up per fold, less
    the first return of the fold's first stretch.
    """
    close = panel.ohlcv["close"]
    slim = panel.with_positions().select(*panel.keys, close, blocks.POS)
    cut = blocks.with_halo(slim, before=1, block_rows=block_rows)
    before = F.lag(close).over(blocks.block_window([panel.asset]))
    rows = blocks.core_rows(cut.withColumn("_prev", before)).withColumn(
        "_r", F.when((F.col(close) > 0) & (F.col("_prev") > 0), F.ln(F.col(close) / F.col("_prev")))
    )
    unit = math.gcd(schedule.step, schedule.train)
    at = fold_position(panel, schedule)
    cell = blocks.floor_div(at - F.lit(schedule.origin), unit)
    cells = rows.groupBy(panel.asset, cell.alias("_cell")).agg(
        F.count("_r").alias("n"),
        F.coalesce(F.sum("_r"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)).alias("q"),
        F.min_by(F.struct(F.col("_r").alias("v")), at).alias("first"),
    )
    low, high = schedule.train_folds(F.lit(schedule.origin) + F.col("_cell") * unit)
    hit = cells.withColumn("_in", F.explode(_memberships(low, high, TRAIN)))
    total = hit.groupBy(panel.asset, F.col("_in.fold_idx").alias("fold_idx")).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.min_by("first", "_cell").alias("first"),
    )
    f = F.coalesce("first.v", F.lit(0.0))
    n = F.col("n") - F.when(F.col("first.v").isNotNull(), 1).otherwise(0)
    mean = F.try_divide(F.col("s") - f, n)
    var = F.greatest(F.try_divide(F.col("q") - f * f, n) - mean * mean, F.lit(0.0))
    vol = F.coalesce(F.sqrt(var), F.lit(0.0))
    return total.select(panel.asset, "fold_idx", vol.alias("volatility"))


def observations(
    ledger: DataFrame,
    context: DataFrame,
    *,
    horizon: int,
    keys: Sequence[str] = ("asset",),
) -> DataFrame:
    """The observation before (``state``) and after (``next_state``) each step.

    ``context`` holds per fold the ``forecast`` array, ``forecast_accuracy`` and
    ``volatility``. A state is the forecast, then position, pnl of the episode so
    far, share of hours left, accuracy and volatility.
    """
    episode = Window.partitionBy(*keys, "fold_idx").orderBy("step")
    with_pnl = ledger if "cum_pnl" in ledger.columns else episode_cum_pnl(ledger, keys)
    prior = with_pnl.withColumn("prior_pnl", F.lag("cum_pnl", 1, 0.0).over(episode))
    joined = prior.join(context, [*keys, "fold_idx"])

    def state(position: str, pnl: str, hour) -> Column:
        left = (F.lit(horizon) - hour) / F.lit(float(horizon))
        tail = F.array(F.col(position), F.col(pnl), left, "forecast_accuracy", "volatility")
        return F.concat(F.col("forecast"), tail)

    return joined.withColumns(
        {
            "state": state("prev_position", "prior_pnl", F.col("step")),
            "next_state": state("position", "cum_pnl", F.col("step") + 1),
        }
    )


def transitions(observed: DataFrame, *, horizon: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """``state, action, reward, next_state, done`` rows out of ``observations``."""
    return observed.select(
        *keys,
        "fold_idx",
        "step",
        "state",
        "action",
        F.col("step_pnl").alias("reward"),
        "next_state",
        (F.col("step") == horizon - 1).alias("done"),
    )


def ledger_equity(
    ledger: DataFrame,
    *,
    horizon: int,
    keys: Sequence[str] = ("asset",),
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Simple return and compounded capital of each step."""
    placed = ledger.withColumn(blocks.POS, ledger_order(horizon))
    summed = blocks.running(placed, keys, {"_sum": ("sum", "step_pnl")}, block_rows=block_rows)
    return summed.withColumns(
        {"strategy_return": F.expm1("step_pnl"), "equity": F.exp("_sum")}
    ).drop("_sum", blocks.POS)


def ledger_summary(
    ledger: DataFrame,
    *,
    horizon: int,
    keys: Sequence[str] = ("asset",),
    annual_factor: int = 8760,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Metrics of the replayed decisions per series."""
    returns = ledger.withColumn("strategy_return", F.expm1("step_pnl"))
    return metrics.compute_all(
        returns, keys, "strategy_return", ledger_order(horizon),
        annual_factor=annual_factor, block_rows=block_rows,
    )
