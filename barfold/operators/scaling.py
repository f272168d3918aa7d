"""Feature and label scaling, fitted per fold on its trimmed training rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators import blocks, selection
from barfold.operators.calendar import Schedule
from barfold.operators.folds import fold_position
from barfold.panel import Panel

METHODS = ("standard", "minmax", "robust")


def _cells(panel: Panel, schedule: Schedule, trim: int, columns: Sequence[str]):
    """Count, mean, variance and range per stretch of positions that every fold
    takes wholly or not at all. Each row is read once, whatever the fold count."""
    unit = math.gcd(schedule.step, schedule.train - trim)
    pos = fold_position(panel, schedule)
    cell = blocks.floor_div(pos - F.lit(schedule.origin), unit)
    stats = []
    for c in columns:
        stats += [
            F.count(c).cast("double").alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__m"),
            F.var_pop(c).alias(f"{c}__v"),
            F.min(c).alias(f"{c}__lo"),
            F.max(c).alias(f"{c}__hi"),
        ]
    return panel.df.groupBy(panel.asset, cell.alias("_cell")).agg(*stats), unit


def _about_first(panel: Panel, cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums about the level of the asset's first stretch, which every expanding fold
    contains: what cancels is no more than the fold's own spread. One row per stretch."""
    whole = Window.partitionBy(panel.asset)
    moments = {}
    for c in columns:
        n, m, v = F.col(f"{c}__n"), F.col(f"{c}__m"), F.col(f"{c}__v")
        level = F.min_by(m, F.when(m.isNotNull(), F.col("_cell"))).over(whole)
        moments[f"{c}__r"] = level
        moments[f"{c}__s"] = n * (m - level)
        moments[f"{c}__q"] = n * (v + (m - level) * (m - level))
    return cells.withColumns(moments)


def _merged(c: str) -> tuple[Column, Column]:
    """Mean and variance over a fold's stretches ``_parts``: deviations are taken from
    the fold's own mean, so no level of the series, near or far, cancels them."""
    parts = F.filter("_parts", lambda p: p[f"{c}__n"] > 0)
    n = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[f"{c}__n"])
    some = F.element_at(parts, 1)[f"{c}__m"]
    # Means are added up as steps from one of them, so they keep all digits.
    mean = some + F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[f"{c}__n"] * (p[f"{c}__m"] - some)), n)

    def about(s: Column, p: Column) -> Column:
        step = p[f"{c}__m"] - mean
        return s + p[f"{c}__n"] * (p[f"{c}__v"] + step * step)

    return F.when(F.size(parts) > 0, mean), F.try_divide(F.aggregate(parts, F.lit(0.0), about), n)


def _fold_moments(panel: Panel, schedule: Schedule, trim: int, columns: Sequence[str]) -> DataFrame:
    cells, unit = _cells(panel, schedule, trim, columns)
    if schedule.mode == "expanding":
        parts = [
            (f"{c}__{k}", op)
            for c in columns
            for k, op in (
                ("n", "sum"), ("s", "sum"), ("q", "sum"), ("lo", "min"), ("hi", "max"), ("r", "max")
            )
        ]
        # Totals up to each stretch; a fold is read off where its window ends.
        usable = _about_first(panel, cells.filter(F.col("_cell") >= 0), columns)
        done = blocks.running(
            usable, [panel.asset], {f"_{n}": (op, n) for n, op in parts}, position="_cell"
        )
        length = schedule.train - trim
        off = (F.col("_cell") + 1) * unit - length
        return (
            done.filter((off >= 0) & (off % schedule.step == 0))
            .withColumn("fold_idx", (off / schedule.step).cast("long"))
            .filter(F.col("fold_idx") < schedule.n_folds)
            .select(panel.asset, "fold_idx", *[F.col(f"_{n}").alias(n) for n, _ in parts])
            .withColumns({f"{c}__{k}": v for c in columns for k, v in _about(c).items()})
        )
    short = Schedule(
        schedule.start, schedule.train - trim, schedule.test, schedule.step,
        schedule.n_folds, schedule.mode, schedule.seconds,
    )
    at = F.lit(schedule.origin) + F.col("_cell") * unit
    hit = blocks.explode_range(cells, "fold_idx", *short.train_folds(at))
    fields = [f"{c}__{k}" for c in columns for k in "nmv"]
    ranges = [pick(f"{c}__{k}").alias(f"{c}__{k}") for c in columns for k, pick in (("lo", F.min), ("hi", F.max))]
    # A fold has as many stretches as its window; they come in the order of the series.
    listed = F.array_sort(F.collect_list(F.struct("_cell", *fields))).alias("_parts")
    folds = hit.groupBy(panel.asset, "fold_idx").agg(listed, *ranges)
    merged = {}
    for c in columns:
        merged[f"{c}__mean"], merged[f"{c}__var"] = _merged(c)
    return folds.withColumns(merged).drop("_parts")


def _about(c: str) -> dict[str, Column]:
    """Mean and variance out of sums about a level."""
    step = F.try_divide(F.col(f"{c}__s"), F.col(f"{c}__n"))
    var = F.greatest(F.try_divide(F.col(f"{c}__q"), F.col(f"{c}__n")) - step * step, F.lit(0.0))
    return {"mean": step + F.col(f"{c}__r"), "var": var}


def _or_one(scale: Column) -> Column:
    """A constant column keeps its spread as 1, so that it scales to 0."""
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def fold_statistics(
    panel: Panel, schedule: Schedule, *, trim: int, method: str, columns: Sequence[str]
) -> DataFrame:
    """Per ``(asset, fold_idx)``: ``<column>__center`` and ``<column>__scale``."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}; use one of {METHODS}")
    if schedule.train <= trim:
        trim = 0
    keys = [panel.asset, "fold_idx"]
    out: list[Column] = []
    if method == "robust":
        # Exact quartiles are not additive, but they can be looked up without copying rows.
        short = Schedule(
            schedule.start, schedule.train - trim, schedule.test, schedule.step,
            schedule.n_folds, schedule.mode, schedule.seconds,
        )
        table = selection.window_percentiles(panel, short, columns, [0.25, 0.5, 0.75])
        for c in columns:
            p = F.col(f"{c}__p")
            out += [p[1].alias(f"{c}__center"), _or_one(p[2] - p[0]).alias(f"{c}__scale")]
        return table.select(*keys, *out)

    table = _fold_moments(panel, schedule, trim, columns)
    for c in columns:
        lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
        if method == "minmax":
            out += [lo.alias(f"{c}__center"), _or_one(hi - lo).alias(f"{c}__scale")]
            continue
        spread = F.when(lo == hi, F.lit(0.0)).otherwise(F.sqrt(f"{c}__var"))
        out += [F.col(f"{c}__mean").alias(f"{c}__center"), _or_one(spread).alias(f"{c}__scale")]
    return table.select(*keys, *out)


@dataclass(frozen=True)
class FoldScaler:
    """Scaling options; ``fit`` gives the statistics of every fold at once."""

    method: str = "standard"
    columns: tuple[str, ...] | None = None
    scale_labels: bool = True

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown scaling method {self.method!r}; use one of {METHODS}")

    def fit(self, panel: Panel, schedule: Schedule, trim: int) -> FittedScaler:
        features = list(self.columns) if self.columns else panel.feature_cols
        labels = panel.label_cols if self.scale_labels else []
        columns = list(dict.fromkeys([*features, *labels]))
        stats = fold_statistics(
            panel, schedule, trim=trim, method=self.method, columns=columns
        )
        return FittedScaler(stats, panel.asset, tuple(columns), tuple(labels))

    def transform(self, rows: DataFrame) -> DataFrame:
        raise RuntimeError("the scaler must be fitted before transform")

    def fit_transform(
        self, panel: Panel, schedule: Schedule, trim: int, rows: DataFrame
    ) -> DataFrame:
        return self.fit(panel, schedule, trim).transform(rows)


@dataclass(frozen=True)
class FittedScaler:
    stats: DataFrame
    asset: str
    columns: tuple[str, ...]
    labels: tuple[str, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Scale rows that carry ``(asset, fold_idx)``; train and test rows alike."""
        joined = rows.join(self.stats, [self.asset, "fold_idx"], "left")
        scaled = {
            c: (F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in self.columns
        }
        return joined.withColumns(scaled).select(*rows.columns)

    def inverse_labels(self, rows: DataFrame, column: str, label: str | None = None) -> DataFrame:
        """``column`` back in units of the label; unchanged when labels are not scaled."""
        if not self.labels:
            return rows
        label = label or self.labels[0]
        center, scale = F.col(f"{label}__center"), F.col(f"{label}__scale")
        slim = self.stats.select(self.asset, "fold_idx", center, scale)
        joined = rows.join(slim, [self.asset, "fold_idx"], "left")
        return joined.withColumn(column, F.col(column) * scale + center).select(*rows.columns)
