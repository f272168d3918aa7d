"""Walk-forward schedules: plain arithmetic on the driver, fold tables on Spark.

A ``Schedule`` is six numbers. Which folds a row belongs to follows from its
position by division, so folds are never joined to rows by range.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.operators import blocks
from barfold.panel import HOUR, Panel

MODES = ("sliding", "expanding")
SCHEDULES = ("in_sample", "in_sample_dense", "oos")


def check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(f"calendar: {message}")


def hours(value: int | str | timedelta) -> int:
    """Whole hours of ``24``, ``"24h"``, ``"30d"``, ``"2w"`` or a timedelta."""
    if isinstance(value, timedelta):
        seconds = value.total_seconds()
        check(seconds % HOUR == 0, f"{value} is not a whole number of hours")
        return int(seconds // HOUR)
    if isinstance(value, int):
        return value
    text = value.strip().lower()
    unit = {"h": 1, "d": 24, "w": 168}.get(text[-1:])
    check(unit is not None and text[:-1].strip().isdigit(), f"cannot read {value!r} as hours")
    return int(text[:-1]) * unit


@dataclass(frozen=True)
class Schedule:
    """``n_folds`` folds of a train window and the test window after it.

    Fold ``j`` trains on ``[start + j*step, + train)`` (from ``start`` on when
    expanding) and tests on the ``test`` grid steps that follow. All lengths
    are in grid steps of ``seconds``.
    """

    start: datetime
    train: int
    test: int
    step: int
    n_folds: int
    mode: str = "sliding"
    seconds: int = HOUR

    def __post_init__(self):
        check(self.mode in MODES, f"unknown mode {self.mode!r}; use one of {MODES}")
        check(
            self.train > 0 and self.test > 0 and self.step > 0,
            "window lengths and step must be positive",
        )

    @property
    def origin(self) -> int:
        """Grid position of ``start``."""
        return int(self.start.replace(tzinfo=timezone.utc).timestamp()) // self.seconds

    def at(self, steps: int) -> datetime:
        return self.start + timedelta(seconds=steps * self.seconds)

    # -- tables --------------------------------------------------------------

    def fold_positions(self, spark: SparkSession) -> DataFrame:
        """One row per fold: positions of its window edges."""
        j = F.col("fold_idx")
        first = F.lit(self.origin)
        begin = first if self.mode == "expanding" else first + j * self.step
        end = first + j * self.step + self.train
        return spark.range(self.n_folds).select(
            F.col("id").alias("fold_idx")
        ).select(
            "fold_idx",
            begin.cast("long").alias("train_from"),
            end.cast("long").alias("train_to"),
            (end + self.test).cast("long").alias("test_to"),
        )

    def boundaries(self, spark: SparkSession) -> DataFrame:
        """One row per fold: times of its window edges, ends exclusive."""
        def time(c):
            return blocks.grid_time(c, self.seconds)

        return self.fold_positions(spark).select(
            "fold_idx",
            time("train_from").alias("train_start"),
            time("train_to").alias("train_end"),
            time("train_to").alias("test_start"),
            time("test_to").alias("test_end"),
        )

    # -- membership by division ----------------------------------------------

    def train_folds(self, position: Column) -> tuple[Column, Column]:
        """First and last fold training on a position; empty when first > last."""
        off = position - F.lit(self.origin)
        low = F.greatest(F.lit(0), blocks.floor_div(off - self.train, self.step) + 1)
        high = F.least(F.lit(self.n_folds - 1), blocks.floor_div(off, self.step))
        if self.mode == "expanding":
            high = F.when(off >= 0, F.lit(self.n_folds - 1)).otherwise(F.lit(-1))
        return low, high

    def test_folds(self, position: Column) -> tuple[Column, Column]:
        off = position - F.lit(self.origin + self.train)
        low = F.greatest(F.lit(0), blocks.floor_div(off - self.test, self.step) + 1)
        high = F.least(F.lit(self.n_folds - 1), blocks.floor_div(off, self.step))
        return low, high

    def fold_of(self, j: Column) -> dict[str, Column]:
        """Window edges (positions) of a fold number, by arithmetic."""
        begin = F.lit(self.origin) + (0 if self.mode == "expanding" else j * self.step)
        end = F.lit(self.origin) + j * self.step + self.train
        return {"train_from": begin, "train_to": end, "test_to": end + self.test}


def splits(
    start: datetime,
    end: datetime,
    *,
    train: int | str | timedelta,
    test: int | str | timedelta,
    step: int | str | timedelta,
    mode: str = "sliding",
    seconds: int = HOUR,
) -> Schedule:
    """Folds from ``start`` on whose test window ends at ``end`` or before.

    With ``end`` at the last bar, as by default elsewhere, the last bar itself
    is never tested, because window ends are exclusive.
    """
    train, test, step = hours(train), hours(test), hours(step)
    check(step > 0, "step must be positive")
    room = (end - start) // timedelta(seconds=seconds) - train - test
    return Schedule(start, train, test, step, max(room // step + 1, 0), mode, seconds)


def splits_of(panel: Panel, **options) -> Schedule:
    """``splits`` over the span of a panel, unless ``start`` or ``end`` is given."""
    if "start" not in options or "end" not in options:
        first, last = panel.df.agg(F.min(panel.time), F.max(panel.time)).first()
        options = {"start": first, "end": last} | options
    return splits(**options)


def split_summary(schedule: Schedule, folds: DataFrame, end: datetime) -> DataFrame:
    """The configuration and the number of folds of a fold table, as one row."""
    unit = f"{schedule.seconds} seconds"
    return folds.agg(F.count(F.lit(1)).alias("n_splits")).select(
        F.lit(schedule.mode).alias("mode"),
        F.lit(schedule.train).alias("train_window"),
        F.lit(schedule.test).alias("test_window"),
        F.lit(schedule.step).alias("step"),
        F.lit(unit).alias("unit"),
        F.lit(schedule.start.isoformat()).alias("start"),
        F.lit(end.isoformat()).alias("end"),
        "n_splits",
    )


@dataclass(frozen=True)
class Geometry:
    """Window lengths in hours shared by all runs; the horizon is also the embargo."""

    train: int
    test: int
    horizon: int
    in_sample_step: int
    oos_step: int
    mode: str = "sliding"


@dataclass(frozen=True)
class Calendar:
    """In-sample and out-of-sample schedules over one gap-free span of hours.

    The cut between the halves moves earlier by less than one horizon, so that
    the out-of-sample half is a whole number of test windows. In-sample folds,
    test windows included, end at the cut; out-of-sample test windows tile
    ``[cut, last]``.
    """

    first: datetime
    last: datetime
    cut_fraction: float
    geometry: Geometry
    longest_lookback: int

    def __post_init__(self):
        g = self.geometry
        check(min(g.train, g.test, g.horizon) > 0, "window lengths must be positive")
        check(g.test == g.horizon, f"test window {g.test} differs from horizon {g.horizon}")
        check(
            g.oos_step == g.horizon,
            f"out-of-sample step {g.oos_step} differs from horizon {g.horizon}",
        )
        check(
            g.in_sample_step > 0 and g.in_sample_step % g.horizon == 0,
            f"in-sample step {g.in_sample_step} is not a multiple of horizon {g.horizon}",
        )
        check(g.mode in MODES, f"unknown mode {g.mode!r}; use one of {MODES}")
        check(0.0 < self.cut_fraction < 1.0, "cut fraction must lie between 0 and 1")
        check(self.longest_lookback > 0, "longest lookback must be positive")
        need = 2 * (self.longest_lookback + g.horizon)
        check(
            g.train - g.horizon >= need,
            f"train window less horizon is {g.train - g.horizon}, but an inner"
            f" validation split needs {need}",
        )
        check(self.first < self.last, "span must not be empty")
        check(
            (self.last - self.first) % timedelta(hours=1) == timedelta(0),
            "span is not a whole number of hours",
        )
        check(self.rows > self._in_rows_wanted, "the cut leaves no out-of-sample rows")
        check(
            self.in_rows >= g.train,
            f"first out-of-sample fold needs {g.train} hours before the cut,"
            f" there are {self.in_rows}",
        )
        check(
            self.in_rows >= g.train + g.horizon,
            f"an in-sample fold needs {g.train + g.horizon} hours before the cut,"
            f" there are {self.in_rows}",
        )

    @property
    def rows(self) -> int:
        return (self.last - self.first) // timedelta(hours=1) + 1

    @property
    def _in_rows_wanted(self) -> int:
        return math.floor(self.cut_fraction * self.rows)

    @property
    def snap(self) -> int:
        """Hours by which the cut moves earlier."""
        return -(self.rows - self._in_rows_wanted) % self.geometry.horizon

    @property
    def in_rows(self) -> int:
        return self._in_rows_wanted - self.snap

    @property
    def oos_rows(self) -> int:
        return self.rows - self.in_rows

    @property
    def cut(self) -> datetime:
        return self.first + timedelta(hours=self.in_rows)

    def folds(self, name: str) -> int:
        g, room = self.geometry, self.in_rows - self.geometry.train
        check(name in SCHEDULES, f"unknown schedule {name!r}; use one of {SCHEDULES}")
        if name == "oos":
            return self.oos_rows // g.horizon
        if name == "in_sample_dense":
            return room // g.horizon
        return (room - g.horizon) // g.in_sample_step + 1

    def schedule(self, name: str) -> Schedule:
        g, n = self.geometry, self.folds(name)
        if name == "oos":
            back, step = g.train, g.oos_step
        else:
            step = g.horizon if name == "in_sample_dense" else g.in_sample_step
            back = g.train + g.test + (n - 1) * step
        return Schedule(self.cut - timedelta(hours=back), g.train, g.test, step, n, g.mode)

    def provenance(self) -> dict:
        """The calendar as plain values, ready for JSON."""
        g = asdict(self.geometry)
        return {
            "t_first": self.first.isoformat(),
            "t_last": self.last.isoformat(),
            "n_total_rows": self.rows,
            "cut_fraction": self.cut_fraction,
            "t_cut": self.cut.isoformat(),
            "snap_adjustment_h": self.snap,
            "geometry": {
                "train_window_h": g["train"],
                "test_window_h": g["test"],
                "embargo_h": g["horizon"],
                "delta_insample_h": g["in_sample_step"],
                "delta_oos_h": g["oos_step"],
                "mode": g["mode"],
            },
            "L_max": self.longest_lookback,
            "n_folds": {name: self.folds(name) for name in SCHEDULES},
            "n_rows": {
                "in_sample_dense": self.folds("in_sample_dense") * g["horizon"],
                "oos": self.oos_rows,
            },
        }

    def provenance_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [("calendar", json.dumps(self.provenance(), sort_keys=True))],
            "name string, payload string",
        )


def span_of(panel: Panel) -> tuple[datetime, datetime]:
    """First and last time over all series: one aggregate, one row."""
    first, last = panel.df.agg(F.min(panel.time), F.max(panel.time)).first()
    check(first is not None, "the table is empty")
    return first, last


def calendar_of(
    panel: Panel, geometry: Geometry, *, cut_fraction: float = 0.5, longest_lookback: int
) -> Calendar:
    return Calendar(*span_of(panel), cut_fraction, geometry, longest_lookback)
