"""Recursive smoothing (EMA, Wilder, EW variance) as windows.

``y_t = d*y_{t-1} + a*x_t`` needs all earlier rows in theory and only about
``log(1e-18)/log(d)`` of them in double precision. A block therefore gets that
many rows of halo and starts afresh there; what is cut off is below rounding.

Inside a block the recurrence is a running sum of ``a*x*d^-j`` times ``d^j``.
The exponent ``j`` restarts every ``stride`` positions, where the end value of
the stride before is carried in; ``stride`` is short enough for ``d^-j`` to
stay finite and long enough that one carry suffices.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators import blocks

STRIDE = 2048
_NEGLIGIBLE = 1e-18
_LARGEST = 1e250


def span_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def wilder_decay(period: int) -> float:
    return 1.0 - 1.0 / period


def memory_rows(decay: float) -> int:
    """Rows after which an old value no longer changes a double."""
    return math.ceil(math.log(_NEGLIGIBLE) / math.log(decay)) if decay > 0 else 0


def _stride(decay: float) -> int:
    longest = math.floor(math.log(_LARGEST) / -math.log(decay))
    if memory_rows(decay) <= STRIDE <= longest:
        return STRIDE
    return 2 ** math.ceil(math.log2(max(memory_rows(decay), 2)))


class SeriesFrame:
    """A blocked table under construction.

    Transforms ask for named columns with ``let``; nothing is added until
    ``finish``, which adds all columns that are ready at once. Equal requests of
    different transforms are made once, and requests over the same window share
    one pass over the rows.
    """

    def __init__(self, df: DataFrame, asset: str, time: str, ohlcv: Mapping[str, str]):
        self.df, self.asset, self.time, self.ohlcv = df, asset, time, dict(ohlcv)
        # ``rows`` is time order inside a block. It is spelled (stride, position) so
        # that it shares its sort with the windows of ``recur``.
        self.rows = Window.partitionBy(asset, blocks.BLOCK).orderBy("_stride", blocks.POS)
        self.wanted: dict[str, tuple[Column, tuple[str, ...], int]] = {}
        self.let("_stride", blocks.floor_div(F.col(blocks.POS), STRIDE))
        self.let("_k", F.row_number().over(self.rows) - 1, "_stride", windows=1)

    def let(self, name: str, value: Column, *needs: str, windows: int = 0) -> Column:
        """Ask for a column. ``needs`` names requested columns it is made of;
        ``windows`` is 1 when it runs over ``rows``, 2 over strides, 0 without window."""
        self.wanted.setdefault(name, (value, needs, windows))
        return F.col(name)

    @property
    def row_number(self) -> Column:
        """Row number inside the block, halo included, from 0."""
        return F.col("_k")

    def lag(self, column: str, n: int = 1) -> Column:
        """Requests ``column`` of ``n`` rows before (after, when negative)."""
        if n == 0:
            return F.col(column)
        moved = F.lag(column, n) if n > 0 else F.lead(column, -n)
        name = f"_{column}_lag_{n}"
        self.let(name, moved.over(self.rows), "_stride", column, windows=1)
        return F.col(name)

    def log_return(self, column: str) -> str:
        """Requests ``ln(P_t / P_{t-1})``, missing on the first row or where not defined;
        returns its name."""
        now, before = F.col(column), self.lag(column)
        ratio = F.when((now > 0) & (before > 0), F.ln(now / before))
        self.let(f"_r_{column}", ratio, f"_{column}_lag_1")
        return f"_r_{column}"

    def power(self, decay: float, unit: str, stride: int) -> str:
        """Requests ``decay^j`` for the place ``j`` of a row in its stride. Made before
        any window runs, so that it is computed once per row and decay."""
        j = (F.col(blocks.POS) - F.col(unit) * stride).cast("double")
        name = f"_pow_{decay}".replace(".", "_")
        self.let(name, F.pow(F.lit(decay), j), unit)
        return name

    def recur(self, name: str, term: Column, decay: float, *needs: str) -> Column:
        """``y = decay*y_before + term``, where missing terms count as 0."""
        if decay == 0:
            return self.let(name, term, *needs, "_k")
        stride = _stride(decay)
        unit = f"_stride_{stride}" if stride != STRIDE else "_stride"
        self.let(unit, blocks.floor_div(F.col(blocks.POS), stride))
        power = self.power(decay, unit, stride)
        part = Window.partitionBy(self.asset, blocks.BLOCK, unit).orderBy(blocks.POS)
        self.let(f"{name}_term", term / F.col(power), power, "_k", *needs)
        running = F.sum(f"{name}_term").over(part.rowsBetween(Window.unboundedPreceding, 0))
        total = self.let(f"{name}_sum", running, f"{name}_term", unit, windows=2)
        at_end = F.col(blocks.POS) == F.col(unit) * stride + stride - 1
        before = F.last(F.when(at_end, total), ignorenulls=True).over(
            self.rows.rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = self.let(f"{name}_carry", before, f"{name}_sum", unit, windows=1)
        carried = carry * F.lit(decay**stride)
        value = F.col(power) * F.coalesce(total + carried, total, carried)
        return self.let(name, value, f"{name}_carry", f"{name}_sum", power)

    def present(self, value: str, first: int) -> Column:
        """``value``, which must not be missing from row ``first`` of a series on."""
        gap = F.raise_error(
            F.concat(F.lit(f"missing {value} near "), F.col(self.time).cast("string"))
        ).cast("double")
        x = F.col(value)
        return F.when(x.isNull() & (F.col("_k") >= first), gap).otherwise(x)

    def ewm_mean(self, name: str, value: str, decay: float, first: int = 0) -> Column:
        """Recursive mean seeded with the value of row ``first``."""
        x, k = self.present(value, first), F.col("_k")
        term = F.when(k == first, x).when(k > first, x * F.lit(1.0 - decay))
        return self.recur(name, term, decay, value)

    def ewm_std(self, name: str, value: str, span: int) -> Column:
        """Debiased EW standard deviation of values from row 1 on; missing before
        ``span`` of them."""
        decay = span_decay(span)
        self.let(f"{value}_sq", F.col(value) * F.col(value), value)
        m = self.ewm_mean(f"{name}_m", value, decay, 1)
        m2 = self.ewm_mean(f"{name}_m2", f"{value}_sq", decay, 1)
        seen, a = F.col("_k"), 1.0 - decay
        # What is left of the first weight, squared: nothing soon.
        gone = F.when(
            seen <= memory_rows(decay), F.pow(F.lit(decay * decay), (seen - 1).cast("double"))
        ).otherwise(F.lit(0.0))
        weights = gone + F.lit(a * a) * (1 - gone) / F.lit(1.0 - decay * decay)
        rest = self.let(f"{name}_rest", F.when((seen >= span) & (seen > 1), 1 - weights), "_k")
        std = F.sqrt(F.try_divide(F.greatest(m2 - m * m, F.lit(0.0)), rest))
        return self.let(name, F.when(rest.isNotNull(), std), f"{name}_m", f"{name}_m2", f"{name}_rest")

    def wilder_mean(self, name: str, value: str, period: int) -> Column:
        """Mean of the ``period`` values after row 0, then Wilder's recurrence.

        The first values enter with weights that undo their decay by row ``period``.
        """
        decay, k = wilder_decay(period), F.col("_k")
        undo = F.pow(F.lit(decay), (k - period).cast("double")) if decay else F.lit(1.0)
        term = F.when(k > period, F.col(value) / period).when(
            (k >= 1) & ((k == period) | F.lit(decay > 0)), F.col(value) / period * undo
        )
        y = self.recur(f"{name}_y", term, decay, value)
        return self.let(name, F.when(k >= period, y), f"{name}_y", "_k")

    def rolling_std(self, name: str, value: str, rows: int, *after: str) -> Column:
        """Sample standard deviation of the last ``rows`` rows; missing before row
        ``rows - 1``.

        A sliding frame costs one update per row in it. So moments are taken over
        short frames, and those of ``rows / short`` neighbouring frames are merged.
        ``after`` delays the merge to the pass in which those columns are ready.
        """
        short = max(d for d in range(1, math.isqrt(rows) + 1) if rows % d == 0)
        if short == 1:
            short = rows
        frame = self.rows.rowsBetween(1 - short, 0)
        mean, var = f"{name}_m{short}", f"{name}_v{short}"
        self.let(mean, F.avg(value).over(frame), "_stride", value, windows=1)
        self.let(var, F.var_pop(value).over(frame), "_stride", value, windows=1)
        parts = range(0, rows, short)
        for n in parts[1:]:
            for c in (mean, var):
                self.let(
                    f"{c}_{n}", F.lag(c, n).over(self.rows), "_stride", c, *after, windows=1
                )
        means = [mean] + [f"{mean}_{n}" for n in parts[1:]]
        spreads = [var] + [f"{var}_{n}" for n in parts[1:]]
        whole = sum((F.col(c) for c in means[1:]), F.col(means[0])) / len(means)
        center = self.let(f"{name}_mean", whole, *means)
        within = sum((F.col(c) for c in spreads[1:]), F.col(spreads[0]))
        between = sum(
            ((F.col(c) - center) * (F.col(c) - center) for c in means[1:]),
            (F.col(means[0]) - center) * (F.col(means[0]) - center),
        )
        std = F.sqrt((within + between) * short / F.lit(float(rows - 1)))
        full = F.when(F.col("_k") >= rows - 1, std)
        return self.let(name, full, f"{name}_mean", *means, *spreads, "_k")

    def finish(self, outputs: Mapping[str, Column]) -> DataFrame:
        """Add what was asked for, then the outputs; drop the rest and the halo."""
        df, done, left = self.df, set(self.df.columns), dict(self.wanted)
        while left:
            ready = {n: w for n, w in left.items() if all(need in done for need in w[1])}
            if not ready:
                raise ValueError(f"columns {sorted(left)} need columns nobody asked for")
            # Plain columns first, then whole blocks, and strides when nothing else is
            # ready: this groups the most requests into one pass.
            kind = min(w[2] for w in ready.values())
            now = {n: w[0] for n, w in ready.items() if w[2] == kind}
            df = df.withColumns(now)
            done.update(now)
            left = {n: w for n, w in left.items() if n not in now}
        df = df.withColumns(dict(outputs))
        scratch = [n for n in self.wanted if n not in outputs]
        return blocks.core_rows(df).drop(*scratch)
