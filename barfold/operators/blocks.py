"""Series cut into bounded blocks, so that no task ever holds a whole series.

A window over ``partitionBy(asset)`` puts a whole series into one task. One
asset may hold a large share of all rows, so every ordered computation here is
partitioned by ``(asset, block)`` instead, in one of two ways:

* bounded look-back or look-ahead (lags, rolling and exponentially weighted
  statistics): ``with_halo`` copies the few rows a block needs from its
  neighbours into it, then plain windows run inside the block;
* unbounded look-back (running sums, running maxima, the previous row of a
  series with holes): ``running`` and ``previous`` aggregate each block once,
  carry the totals over the block table, and add the carry to the in-block
  running value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.session import stored

BLOCK_ROWS = 16384
BLOCK = "_block"
CORE = "_core"
POS = "_pos"


def grid_position(time: Column | str, seconds: int) -> Column:
    """Whole grid steps since the epoch."""
    col = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_seconds(col.cast("timestamp")) / F.lit(seconds)).cast("long")


def grid_time(position: Column | str, seconds: int) -> Column:
    """Inverse of ``grid_position`` on grid points."""
    col = F.col(position) if isinstance(position, str) else position
    return F.timestamp_seconds(col * F.lit(seconds)).cast("timestamp_ntz")


def floor_time(time: Column, unit: str) -> Column:
    """``date_trunc`` that stays a timestamp without zone."""
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def floor_div(a: Column, b: int | Column) -> Column:
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("long")


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("long")


def explode_range(df: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    """One copy of each row per integer in ``[low, high]``; none when empty.

    ``sequence`` counts down when ``low > high``, hence the filter.
    """
    lo, hi = f"_{name}_lo", f"_{name}_hi"
    return (
        df.withColumns({lo: low.cast("long"), hi: high.cast("long")})
        .filter(F.col(lo) <= F.col(hi))
        .withColumn(name, F.explode(F.sequence(F.col(lo), F.col(hi))))
        .drop(lo, hi)
    )


def with_halo(
    df: DataFrame,
    *,
    before: int = 0,
    after: int = 0,
    position: str = POS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``_block`` and ``_core``; rows near a block edge are copied across it.

    Every row is the core row of exactly one block. A block also holds the
    ``before`` positions ahead of it and the ``after`` positions behind it.
    """
    pos = F.col(position)
    own = floor_div(pos, block_rows)
    if before == 0 and after == 0:
        return df.withColumns({BLOCK: own, CORE: F.lit(True)})
    out = explode_range(
        df, BLOCK, floor_div(pos - after, block_rows), floor_div(pos + before, block_rows)
    )
    return out.withColumn(CORE, F.col(BLOCK) == own)


def block_window(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys, BLOCK).orderBy(*(order or (POS,)))


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the copies made by ``with_halo``."""
    return df.filter(F.col(CORE)).drop(CORE, BLOCK)


def rank_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, out: str = POS
) -> DataFrame:
    """Consecutive row numbers per series, from 0, without a window over rows.

    Rows are sorted by series and order into ranges that Spark cuts from a sample of
    the rows, so a series, a day or a minute that holds much of the table is spread over
    as many tasks as it needs. Numbers within a range are places in its sorted file; the
    offsets come from the table of counts, one row for each series and range.
    """
    at, part = "_at", "_part"
    placed = stored(df.orderBy(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    # The number of the range is in the upper bits, the place in it below.
    placed = placed.withColumn(part, F.shiftright(at, 33))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first"))
        .drop("_n", "_first")
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, part)]
    joined = placed.alias("a").join(offsets.alias("b"), reduce(and_, same))
    return joined.select("a.*", (F.col(f"a.{at}") + F.col("b._offset")).alias(out)).drop(at, part)


_SUMMARY = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "product": F.product,
}


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry + local, local, carry)
    if op == "product":
        return F.coalesce(carry * local, local, carry)
    if op == "max":
        return F.greatest(carry, local)
    if op == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, tuple[str, str | Column]],
    *,
    position: str = POS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running ``sum``, ``max``, ``min``, ``product`` or ``last`` (non-null) per series.

    ``columns`` maps output name to ``(op, value)``. The value counts from the
    first row of the series up to and including the row itself.
    """
    values = {
        f"_v{n}": F.col(v) if isinstance(v, str) else v
        for n, (_, v) in enumerate(columns.values())
    }
    cut = df.withColumn(BLOCK, floor_div(F.col(position), block_rows)).withColumns(values)
    ops = [op for op, _ in columns.values()]

    def whole(n: int, op: str) -> Column:
        if op == "last":
            seen = F.when(F.col(f"_v{n}").isNotNull(), F.col(position))
            return F.max_by(f"_v{n}", seen)
        return _SUMMARY[op](f"_v{n}")

    totals = cut.groupBy(*keys, BLOCK).agg(
        *[whole(n, op).alias(f"_t{n}") for n, op in enumerate(ops)]
    )
    ahead = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = totals.select(
        *keys,
        BLOCK,
        *[
            (
                F.last(f"_t{n}", ignorenulls=True) if op == "last" else _SUMMARY[op](f"_t{n}")
            ).over(ahead).alias(f"_c{n}")
            for n, op in enumerate(ops)
        ],
    )
    inside = block_window(keys, position).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carries, [*keys, BLOCK])
    local = {
        f"_l{n}": (
            F.last(f"_v{n}", ignorenulls=True) if op == "last" else _SUMMARY[op](f"_v{n}")
        ).over(inside)
        for n, op in enumerate(ops)
    }
    done = joined.withColumns(local).withColumns(
        {
            out: _combine(op, F.col(f"_c{n}"), F.col(f"_l{n}"))
            for n, (out, (op, _)) in enumerate(columns.items())
        }
    )
    scratch = [f"_{p}{n}" for n in range(len(ops)) for p in "vcl"]
    return done.drop(BLOCK, *scratch)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str | Column],
    *,
    position: str = POS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the preceding row of the series, whatever the distance to it.

    NULL on the first row. ``columns`` maps output name to value.
    """
    fields = {
        f"_p{n}": F.col(v) if isinstance(v, str) else v for n, v in enumerate(columns.values())
    }
    cut = df.withColumn(BLOCK, floor_div(F.col(position), block_rows)).withColumn(
        "_row", F.struct(*[c.alias(a) for a, c in fields.items()])
    )
    edge = cut.groupBy(*keys, BLOCK).agg(F.max_by("_row", position).alias("_edge"))
    carries = edge.select(
        *keys,
        BLOCK,
        F.lag("_edge").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_carry"),
    )
    inside = block_window(keys, position)
    return (
        cut.join(carries, [*keys, BLOCK])
        .withColumn("_prior", F.coalesce(F.lag("_row").over(inside), F.col("_carry")))
        .withColumns({out: F.col(f"_prior._p{n}") for n, out in enumerate(columns)})
        .drop("_row", "_prior", "_carry", BLOCK)
    )
