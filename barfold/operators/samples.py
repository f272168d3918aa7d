"""Model inputs and targets out of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.operators import blocks
from barfold.operators.calendar import Schedule
from barfold.operators.folds import TEST, TRAIN, assign_folds, fold_ends, fold_position, numbered_rows, window_rows
from barfold.panel import Panel


def tabular(panel: Panel) -> DataFrame:
    """One sample per row: the feature vector ``x`` and the label (vector) ``y``."""
    labels = panel.label_cols
    y = F.col(labels[0]) if len(labels) == 1 else F.array(*labels)
    return panel.df.select(*panel.keys, F.array(*panel.feature_cols).alias("x"), y.alias("y"))


def _blocked(panel: Panel, before: int, after: int, block_rows: int) -> DataFrame:
    need = [*panel.keys, *panel.feature_cols, *panel.label_cols]
    slim = panel.with_positions().select(*need, blocks.POS)
    return blocks.with_halo(
        slim, before=before, after=after, block_rows=max(block_rows, before, after)
    ).repartition(panel.asset, blocks.BLOCK)


def sequences(
    panel: Panel, lookback: int, horizon: int, *, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Stride-1 windows: ``x`` is ``lookback`` feature rows, ``y`` the next ``horizon``
    label rows; the sample is stamped with the time of its first target row.

    A series with fewer than ``lookback + horizon`` rows has no sample; see
    ``require_rows`` for the error. ``x`` repeats every row ``lookback`` times,
    so fits build it inside the task instead of reading it from here.
    """
    if lookback <= 0 or horizon <= 0:
        raise ValueError("lookback and horizon must be positive")
    cut = _blocked(panel, lookback, horizon - 1, block_rows)
    rows = blocks.block_window([panel.asset])
    done = cut.withColumns(
        {
            "x": F.collect_list(F.array(*panel.feature_cols)).over(
                rows.rowsBetween(-lookback, -1)
            ),
            "y": F.collect_list(F.array(*panel.label_cols)).over(
                rows.rowsBetween(0, horizon - 1)
            ),
        }
    )
    full = (F.size("x") == lookback) & (F.size("y") == horizon)
    return blocks.core_rows(done).filter(full).select(*panel.keys, "x", "y")


def require_rows(panel: Panel, lookback: int, horizon: int) -> None:
    """Raise when a series is too short for one sequence sample."""
    short = (
        panel.df.groupBy(panel.asset)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") < lookback + horizon)
        .orderBy(panel.asset)
        .first()
    )
    if short is not None:
        raise ValueError(
            f"{short[0]} has {short[1]} rows, but lookback {lookback} and horizon"
            f" {horizon} need {lookback + horizon}"
        )


def dms_targets(
    panel: Panel, horizon: int, *, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Direct multi-step targets: ``y`` holds the labels of the row and of the next
    ``horizon - 1`` rows. The last ``horizon`` rows of a series have none."""
    label = panel.label_cols[0]
    cut = _blocked(panel, 0, horizon, block_rows)
    rows = blocks.block_window([panel.asset])
    ahead = F.collect_list(F.struct(F.col(label).alias("v"))).over(rows.rowsBetween(0, horizon))
    done = blocks.core_rows(cut.withColumn("_y", ahead)).filter(F.size("_y") == horizon + 1)
    return done.select(
        *panel.keys,
        F.array(*panel.feature_cols).alias("x"),
        F.slice(F.col("_y.v"), 1, horizon).alias("y"),
    )


def inner_split_size(n: int, lookback: int, horizon: int, ratio: float) -> int | None:
    """Rows of the inner validation block at the end of ``n`` training rows, if any."""
    window = lookback + horizon
    if n < 2 * window:
        return None
    return min(max(int(n * ratio), window), n - window)


def inner_split(
    rows: DataFrame, asset: str, lookback: int, horizon: int, ratio: float = 0.1
) -> DataFrame:
    """Add ``part``: the last block of a fold's training rows is ``val``.

    ``rows`` are all trimmed training rows of their folds; a fold too short for two
    sequence windows is all ``train``. A row's place in its fold follows from row numbers.
    """
    window = lookback + horizon
    numbered = numbered_rows(rows.filter(F.col("role") == TRAIN), asset)
    placed = numbered.join(fold_ends(numbered, asset), [asset, "fold_idx"])
    n = F.col("_last") - F.col("_first") + 1
    size = F.least(F.greatest(F.floor(n * F.lit(ratio)), F.lit(window)), n - window)
    val = (n >= 2 * window) & (F.col("_row") > F.col("_last") - size)
    return placed.withColumn("part", F.when(val, "val").otherwise("train")).select(*rows.columns, "part")


def sequence_context(panel: Panel, schedule: Schedule, lookback: int) -> DataFrame:
    """Per fold the last ``lookback`` existing feature rows of the untrimmed training window.

    On a grid these are the rows of the last ``lookback`` steps. On series with holes
    rows are numbered, the folds' edges are read off row counts, and the wanted numbers
    are joined; no window spans a fold.
    """
    pos = fold_position(panel, schedule)
    if panel.grid_seconds:
        # Only rows within ``lookback`` of a window end go to a fold.
        end = Schedule(
            schedule.at(schedule.train - lookback), lookback, schedule.test,
            schedule.step, schedule.n_folds, "sliding", schedule.seconds,
        )
        low, high = end.train_folds(pos)
        hit = blocks.explode_range(panel.df.withColumn(blocks.POS, pos), "fold_idx", low, high)
        # A short training window begins after the first of these rows.
        hit = hit.filter(F.col(blocks.POS) >= schedule.fold_of(F.col("fold_idx"))["train_from"])
    else:
        hit = _last_rows(panel, schedule, lookback)
    item = F.struct(F.col(blocks.POS), F.array(*panel.feature_cols).alias("f"))
    return hit.groupBy(panel.asset, "fold_idx").agg(
        F.array_sort(F.collect_list(item)).alias("_c")
    ).select(panel.asset, "fold_idx", F.col("_c.f").alias("x"))


def _last_rows(panel: Panel, schedule: Schedule, lookback: int) -> DataFrame:
    """Rows with ``fold_idx``: the last ``lookback`` of each fold's training window, whatever the holes."""
    asset = panel.asset
    numbered = panel.with_row_numbers("_row").withColumn(blocks.POS, fold_position(panel, schedule))
    first = F.greatest(F.col("_first"), F.col("_last") - lookback + 1)
    wanted = blocks.explode_range(window_rows(panel, schedule), "_row", first, F.col("_last"))
    return numbered.join(wanted.select(asset, "fold_idx", "_row"), [asset, "_row"])


def tabular_context(panel: Panel, schedule: Schedule) -> DataFrame:
    """Per fold the features of the first existing test row. Unlike ``sequence_context``
    this sees the bar at the start of the test window."""
    tests = assign_folds(panel, schedule, (TEST,))
    x = F.array(*panel.feature_cols).alias("x")
    if panel.grid_seconds:
        start = schedule.fold_of(F.col("fold_idx"))["train_to"]
        return tests.filter(F.col(blocks.POS) == start).select(panel.asset, "fold_idx", panel.time, x)
    row = F.struct(F.col(panel.time).alias("t"), x)
    first = tests.groupBy(panel.asset, "fold_idx").agg(F.min_by(row, blocks.POS).alias("_r"))
    return first.select(panel.asset, "fold_idx", F.col("_r.t").alias(panel.time), "_r.x")
