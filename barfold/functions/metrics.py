"""Performance metrics of return series, many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators import blocks

METRICS = ("sharpe_ratio", "total_return", "max_drawdown", "volatility", "win_rate")


def _drawdown_parts(value: Column) -> Column:
    """Growth factor of a row; series that lose everything need ``exact``."""
    growth = 1.0 + value
    return F.when(growth <= 0, F.raise_error(F.lit(
        "a return of -100% or less; use max_drawdown(exact=True) and compute the"
        " other metrics with drawdown=False"
    )).cast("double")).otherwise(growth)


def _order(order: str | Column) -> Column:
    return F.col(order) if isinstance(order, str) else order


def _block_table(
    df: DataFrame, keys: Sequence[str], value: str, order, block_rows: int, drawdown: bool
) -> DataFrame:
    """One row per block of a series with all that the metrics need of it.

    Equity and its peak are products and maxima, so a block can be summed up
    without what came before; only this small table is ordered per series.
    """
    r = F.col(value)
    rows = df.select(*keys, r.cast("double").alias("_r"), _order(order).alias(blocks.POS))
    rows = rows.withColumn(blocks.BLOCK, blocks.floor_div(F.col(blocks.POS), block_rows))
    r = F.col("_r")
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count(r).alias("n"),
        F.avg(r).alias("m"),
        F.var_pop(r).alias("v"),
        F.min(r).alias("lo"),
        F.max(r).alias("hi"),
        F.count_if(r > 0).alias("up"),
        F.count_if((r != 0) | r.isNull()).alias("active"),
        F.product(1.0 + r).alias("growth"),
    ]
    if not drawdown:
        return rows.groupBy(*keys, blocks.BLOCK).agg(*aggs)
    inside = blocks.block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("_e", F.product(_drawdown_parts(r)).over(inside))
    peaked = grown.withColumn("_peak", F.max("_e").over(inside))
    return peaked.groupBy(*keys, blocks.BLOCK).agg(
        *aggs,
        F.max("_e").alias("top"),
        F.min("_e").alias("bottom"),
        F.min(F.col("_e") / F.col("_peak")).alias("low"),
    )


def compute_all(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str | Column,
    *,
    annual_factor: int = 365,
    block_rows: int = blocks.BLOCK_ROWS,
    drawdown: bool = True,
) -> DataFrame:
    """All metrics of the simple returns ``value`` per series ``keys``.

    ``order`` is an increasing position (or grid position) of a row. Without
    keys the result has one row, also for an empty table.
    """
    table = _block_table(df, keys, value, order, block_rows, drawdown)
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    mean = F.try_divide(
        F.sum(F.col("n") * F.col("m")).over(whole), F.sum("n").over(whole).cast("double")
    )
    placed = table.withColumn("mean", mean)
    shift = F.col("m") - F.col("mean")
    aggs = [
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.first("mean", ignorenulls=True).alias("mean"),
        F.sum(F.col("n") * (F.col("v") + shift * shift)).alias("ss"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("up").alias("up"),
        F.sum("active").alias("active"),
        F.product("growth").alias("growth"),
    ]
    if drawdown:
        placed = placed.withColumn(
            "before", F.coalesce(F.product("growth").over(ahead), F.lit(1.0))
        ).withColumn("peak", F.max(F.col("before") * F.col("top")).over(ahead))
        from_old_peak = F.col("before") * F.col("bottom") / F.col("peak")
        placed = placed.withColumn("worst", F.least(F.col("low"), from_old_peak))
        aggs.append(F.min("worst").alias("worst"))
    total = placed.groupBy(*keys).agg(*aggs)

    std = F.when(F.col("n") > 1, F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(
        F.sqrt(F.col("ss") / (F.col("n") - 1))
    ))
    year = F.lit(math.sqrt(annual_factor))
    none = F.coalesce(F.col("rows"), F.lit(0)) == 0
    return total.withColumn("std", std).select(
        *keys,
        F.when(none | (F.col("std") == 0), F.lit(0.0))
        .otherwise(F.try_divide(F.col("mean"), F.col("std")) * year)
        .alias("sharpe_ratio"),
        (F.coalesce("growth", F.lit(1.0)) - 1).alias("total_return"),
        *([(F.col("worst") - 1).alias("max_drawdown")] if drawdown else []),
        (F.col("std") * year).alias("volatility"),
        F.coalesce(F.try_divide(F.col("up").cast("double"), F.col("active")), F.lit(0.0)).alias(
            "win_rate"
        ),
    )


def _one(name: str):
    def metric(df, keys, value, order, **options) -> DataFrame:
        drawdown = name == "max_drawdown"
        return compute_all(df, keys, value, order, drawdown=drawdown, **options).select(
            *keys, name
        )

    metric.__name__ = name
    metric.__doc__ = f"``{name}`` alone, per series; options as in ``compute_all``."
    return metric


sharpe = _one("sharpe_ratio")
total_return = _one("total_return")
volatility = _one("volatility")
win_rate = _one("win_rate")


def max_drawdown(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str | Column,
    *,
    exact: bool = False,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Largest fall from an earlier peak of the compounded value; peaks start at the
    first row, not at 1. ``exact`` also follows equity through zero and below."""
    if not exact:
        return compute_all(df, keys, value, order, block_rows=block_rows).select(
            *keys, "max_drawdown"
        )
    rows = df.select(*keys, F.col(value).alias("_r"), _order(order).alias(blocks.POS))
    equity = blocks.running(
        rows, keys, {"_e": ("product", 1.0 + F.col("_r"))}, block_rows=block_rows
    )
    peaked = blocks.running(equity, keys, {"_peak": ("max", "_e")}, block_rows=block_rows)
    fall = F.try_divide(F.col("_e") - F.col("_peak"), F.col("_peak"))
    return peaked.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"))
