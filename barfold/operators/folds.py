"""Rows of a panel assigned to the folds of a schedule."""

from __future__ import annotations

import math
import warnings
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators import blocks
from barfold.operators.calendar import Calendar, Schedule
from barfold.panel import Panel

TRAIN, TEST = "train", "test"


def fold_position(panel: Panel, schedule: Schedule):
    """Position of a row on the grid of the schedule. Fold edges are times."""
    return blocks.grid_position(panel.time, schedule.seconds)


def _memberships(low, high, role: str):
    none = F.array().cast("array<struct<fold_idx:bigint,role:string>>")
    each = F.transform(
        F.sequence(low, high),
        lambda j: F.struct(j.cast("long").alias("fold_idx"), F.lit(role).alias("role")),
    )
    return F.when(low <= high, each).otherwise(none)


def assign_folds(
    panel: Panel, schedule: Schedule, roles: tuple[str, ...] = (TRAIN, TEST)
) -> DataFrame:
    """One copy of each row per fold it trains or is tested in.

    The fold numbers come from the row's own position, so this is a narrow
    step: no join, no shuffle. A row is in about ``train/step`` folds; where
    additive statistics or whole fits per fold are wanted, ``scaling`` and
    ``walkforward`` avoid these copies.
    """
    pos = fold_position(panel, schedule)
    parts = []
    if TRAIN in roles:
        parts.append(_memberships(*schedule.train_folds(pos), TRAIN))
    if TEST in roles:
        parts.append(_memberships(*schedule.test_folds(pos), TEST))
    if schedule.n_folds == 0:
        parts = [F.array().cast("array<struct<fold_idx:bigint,role:string>>")]
    return (
        panel.df.withColumn(blocks.POS, pos)
        .withColumn("_in", F.explode(F.concat(*parts)))
        .select("*", "_in.fold_idx", "_in.role")
        .drop("_in")
    )


def bind(panel: Panel, calendar: Calendar, name: str) -> DataFrame:
    """Rows of a panel in the folds of one schedule of a calendar."""
    return assign_folds(panel, calendar.schedule(name))


def nonempty_folds(panel: Panel, schedule: Schedule) -> DataFrame:
    """Per asset the folds with both a training and a test row, with row counts.

    Rows are counted once per stretch of ``step`` positions before they are
    copied to folds.
    """
    counted = fold_counts(panel, schedule)
    return counted.filter((F.col("n_train") > 0) & (F.col("n_test") > 0))


def fold_counts(panel: Panel, schedule: Schedule) -> DataFrame:
    unit = math.gcd(schedule.step, schedule.train, schedule.test)
    pos = fold_position(panel, schedule)
    cell = blocks.floor_div(pos - F.lit(schedule.origin), unit)
    cells = panel.df.groupBy(panel.asset, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    at = F.lit(schedule.origin) + F.col("_cell") * unit
    parts = [
        _memberships(*schedule.train_folds(at), TRAIN),
        _memberships(*schedule.test_folds(at), TEST),
    ]
    hit = cells.withColumn("_in", F.explode(F.concat(*parts)))

    def rows(role):
        n = F.sum(F.when(F.col("_in.role") == role, F.col("_n")))
        return F.coalesce(n, F.lit(0)).alias(f"n_{role}")

    return hit.groupBy(panel.asset, F.col("_in.fold_idx").alias("fold_idx")).agg(
        rows(TRAIN), rows(TEST)
    )


def embargo_trim(rows: DataFrame, schedule: Schedule, horizon: int) -> DataFrame:
    """Training rows without the last ``horizon`` grid steps of each fold's window.

    Test rows pass. A window not longer than the horizon is kept whole, with a
    warning, as there would be nothing left.
    """
    if schedule.train <= horizon and schedule.mode == "sliding":
        warnings.warn(
            f"training window of {schedule.train} rows is not longer than horizon"
            f" {horizon}; nothing is trimmed",
            UserWarning,
            stacklevel=2,
        )
        return rows
    limit = schedule.fold_of(F.col("fold_idx"))["train_to"] - horizon
    return rows.filter((F.col("role") != TRAIN) | (F.col(blocks.POS) < limit))


def numbered_rows(rows: DataFrame, asset: str) -> DataFrame:
    """Add ``_row``, a row's number in its series, to rows in folds, unless it is there.

    A row has one number however many folds it is in, so only the positions are numbered.
    """
    if "_row" in rows.columns:
        return rows
    places = rows.select(asset, blocks.POS).distinct()
    return rows.join(blocks.rank_positions(places, [asset], [blocks.POS], out="_row"), [asset, blocks.POS])


def fold_ends(numbered: DataFrame, asset: str) -> DataFrame:
    """First and last row number of each fold's training rows: ``_first``, ``_last``.

    The rows of a window follow each other in the series, so these two numbers place
    every row in its fold; nothing is sorted by fold.
    """
    training = numbered.filter(F.col("role") == TRAIN)
    return training.groupBy(asset, "fold_idx").agg(
        F.min("_row").alias("_first"), F.max("_row").alias("_last")
    )


def embargo_trim_rows(rows: DataFrame, asset: str, horizon: int) -> DataFrame:
    """The same by row count, for series with holes: the last ``horizon`` rows go.

    ``rows`` has all training rows of a fold's window. A window of no more rows is kept.
    """
    numbered = numbered_rows(rows, asset)
    placed = numbered.join(fold_ends(numbered, asset), [asset, "fold_idx"], "left")
    back, size = F.col("_last") - F.col("_row"), F.col("_last") - F.col("_first") + 1
    keep = (F.col("role") != TRAIN) | (back >= horizon) | (size <= horizon)
    return placed.filter(keep).select(*rows.columns)


def last_train_label(panel: Panel, schedule: Schedule, horizon: int) -> DataFrame:
    """Per asset and fold the time of the last training row after the trim.

    On a grid that row is known by arithmetic; otherwise it is looked up.
    """
    trim = horizon if schedule.train > horizon else 0
    if panel.grid_seconds:
        assets = panel.df.groupBy(panel.asset).agg(
            F.min(fold_position(panel, schedule)).alias("_from"),
            F.max(fold_position(panel, schedule)).alias("_to"),
        )
        last = schedule.fold_of(F.col("fold_idx"))["train_to"] - trim - 1
        first = schedule.fold_of(F.col("fold_idx"))["train_from"]
        return (
            blocks.explode_range(assets, "fold_idx", F.lit(0), F.lit(schedule.n_folds - 1))
            .withColumn("_last", F.least(last, F.col("_to")))
            .filter((F.col("_last") >= F.col("_from")) & (F.col("_last") >= first))
            .select(
                panel.asset,
                "fold_idx",
                blocks.grid_time("_last", schedule.seconds).alias("last_train_label_ts"),
            )
        )
    # One row of each fold is looked up by its number; rows are not copied to folds.
    numbered = panel.with_row_numbers("_row").select(panel.asset, panel.time, "_row")
    ends = window_rows(panel, schedule)
    size = F.col("_last") - F.col("_first") + 1
    row = F.when(size > horizon, F.col("_last") - horizon).otherwise(F.col("_last"))
    wanted = ends.select(panel.asset, "fold_idx", row.alias("_row"))
    return wanted.join(numbered, [panel.asset, "_row"]).select(
        panel.asset, "fold_idx", F.col(panel.time).alias("last_train_label_ts")
    )


def window_rows(panel: Panel, schedule: Schedule) -> DataFrame:
    """Per asset and fold the first and last row number of its training window, holes or
    not; folds without a training row are left out.

    Rows are counted per stretch between window edges, and the counts are added up along
    the series.
    """
    origin, step, train = schedule.origin, schedule.step, schedule.train
    off = fold_position(panel, schedule) - F.lit(origin)
    # Two edges a step: where a window begins and where one ends.
    phase = train % step
    cell = 2 * blocks.floor_div(off, step) + F.when(off - step * blocks.floor_div(off, step) >= phase, 1).otherwise(0)
    counts = panel.df.groupBy(panel.asset, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(panel.asset).orderBy("_cell")
    total = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.withColumns({"_upto": total, "_next": F.lead("_cell").over(order)})

    def before(name: str, at: int, moves: int) -> DataFrame:
        """Rows before edge ``at + j * moves`` of each fold j."""
        # After a cell come all edges up to that of the next cell with rows.
        if moves == 0:
            none = ends.groupBy(panel.asset).agg(
                F.coalesce(F.max(F.when(F.col("_cell") < at, F.col("_upto"))), F.lit(0)).alias(name)
            )
            return blocks.explode_range(none, "fold_idx", F.lit(0), F.lit(schedule.n_folds - 1))
        low = F.greatest(F.lit(0), blocks.floor_div(F.col("_cell") - at, moves) + 1)
        high = F.least(F.lit(schedule.n_folds - 1), F.coalesce(blocks.floor_div(F.col("_next") - at, moves), F.lit(schedule.n_folds - 1)))
        return blocks.explode_range(ends, "fold_idx", low, high).select(panel.asset, "fold_idx", F.col("_upto").alias(name))

    begins = before("_first", 0, 0 if schedule.mode == "expanding" else 2)
    finish = before("_end", 2 * (train // step) + (1 if phase else 0), 2)
    both = finish.join(begins, [panel.asset, "fold_idx"], "left")
    first, last = F.coalesce("_first", F.lit(0)), F.col("_end") - 1
    return both.select(panel.asset, "fold_idx", first.alias("_first"), last.alias("_last")).filter(
        F.col("_first") <= F.col("_last")
    )


def test_starts(schedule: Schedule) -> list[datetime]:
    return [schedule.at(j * schedule.step + schedule.train) for j in range(schedule.n_folds)]
