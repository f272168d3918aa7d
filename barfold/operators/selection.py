"""Exact order statistics of many overlapping windows of long series.

A row is in ``train / step`` sliding windows, or in all later expanding ones, so
copying rows to windows and sorting there costs the windows' sizes together.
Here the values of a series are sorted once, and every row gets its rank. Ranks
form a tree of value cells: ``RADIX`` cells a level, ``CELL_ROWS`` rows in a leaf.
Level by level, rows are counted per cell and stretch between window edges, the
counts are added up along the series, and each window reads off how many of its
rows lie in the cells below its place; the cell that holds the wanted order
statistic is opened on the next level. In the end a window looks at its rows in
one leaf. Counts are integers, so results are exact; no row is copied to windows.

A task holds one leaf and the places wanted in it by some thousand windows. What
runs along a series are tables of counts, one row for each cell and stretch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.operators import blocks
from barfold.operators.calendar import Schedule
from barfold.operators.folds import fold_position
from barfold.panel import Panel
from barfold.session import stored

#: Rows of a leaf, cells that a cell is cut into, windows that share a task of a leaf.
CELL_ROWS = 16384
RADIX = 64
WINDOWS = 4096


def _stretch(position: Column, schedule: Schedule) -> Column:
    """Number of the stretch between window edges: two edges a step, as windows begin and end."""
    off = position - F.lit(schedule.origin)
    periods = blocks.floor_div(off, schedule.step)
    return 2 * periods + F.when(off - schedule.step * periods >= schedule.train % schedule.step, 1).otherwise(0)


def _edges(fold: Column, schedule: Schedule) -> tuple[Column, Column]:
    """First stretch of a fold's training window and the one after its last."""
    first = F.lit(0) if schedule.mode == "expanding" else 2 * fold
    end = 2 * (fold + schedule.train // schedule.step) + (1 if schedule.train % schedule.step else 0)
    return first.cast("long"), end.cast("long")


def window_counts(
    counts: DataFrame, wanted: DataFrame, keys: Sequence[str], schedule: Schedule
) -> DataFrame:
    """``wanted (*keys, cell, fold_idx)`` with ``n``: rows of the cell in the fold's training window.

    ``counts`` has the rows of each cell and stretch, ``(*keys, cell, stretch, rows)``.
    """
    first, end = _edges(F.col("fold_idx"), schedule)
    none = F.lit(None).cast("long")
    # Before the rows of its own stretch, an edge sees those of all stretches ahead of it.
    events = counts.select(*keys, "cell", F.col("stretch").alias("at"), F.lit(1).alias("kind"), "rows", none.alias("fold_idx"), F.lit(0).alias("sign"))
    marks = [
        wanted.select(*keys, "cell", at.alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rows"), "fold_idx", F.lit(sign).alias("sign"))
        for at, sign in ((first, -1), (end, 1))
    ]
    along = Window.partitionBy(*keys, "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(marks[0]).unionByName(marks[1]).withColumn("seen", F.sum("rows").over(along))
    return seen.filter("sign <> 0").groupBy(*keys, "cell", "fold_idx").agg(F.sum(F.col("sign") * F.col("seen")).alias("n"))


def _opened(cells: Column, rank: Column) -> Column:
    """The cell with the row of this rank, and the rank within it; cells are ``(cell, n)`` in ascending order."""
    start = F.struct(rank.alias("rank"), F.lit(None).cast("long").alias("cell"))

    def step(s: Column, c: Column) -> Column:
        here = s["cell"].isNull() & (s["rank"] < c["n"])
        after = F.when(s["cell"].isNull() & ~here, s["rank"] - c["n"]).otherwise(s["rank"])
        return F.struct(after.alias("rank"), F.when(here, c["cell"]).otherwise(s["cell"]).alias("cell"))

    return F.aggregate(cells, start, step)


def window_percentiles(
    panel: Panel,
    schedule: Schedule,
    columns: Sequence[str],
    at: Sequence[float],
    *,
    cell_rows: int | None = None,
    radix: int | None = None,
) -> DataFrame:
    """Per ``(asset, fold_idx)`` the percentiles ``at`` of each column over the fold's training
    window, interpolated linearly, as arrays ``<column>__p``; NULLs don't count."""
    cell_rows, radix = cell_rows or CELL_ROWS, radix or RADIX
    asset = panel.asset
    keys = [asset, "_c"]
    here = panel.df.withColumn(blocks.POS, fold_position(panel, schedule))
    inside = F.col(blocks.POS) >= F.lit(schedule.origin)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_c"), F.col(c).cast("double").alias("v")) for n, c in enumerate(columns)]))
    melted = here.filter(inside).select(asset, blocks.POS, each.alias("_e")).select(asset, blocks.POS, "_e.*").filter("v IS NOT NULL")
    ranked = blocks.rank_positions(melted, keys, ["v", blocks.POS], out="rank")
    rows = stored(ranked.select(*keys, blocks.POS, "v", "rank", _stretch(F.col(blocks.POS), schedule).cast("long").alias("stretch")))

    # The size of every window says which places are wanted: those about each percentile.
    most = (rows.agg(F.max("rank")).first()[0] or 0) + 1
    all_rows = rows.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("rows")).withColumn("cell", F.lit(0).cast("long"))
    folds = blocks.explode_range(rows.select(*keys).distinct(), "fold_idx", F.lit(0), F.lit(schedule.n_folds - 1))
    sizes = stored(window_counts(all_rows, folds.withColumn("cell", F.lit(0).cast("long")), keys, schedule).filter("n > 0").drop("cell"))
    place = F.explode(F.array(*[F.floor((F.col("n") - 1) * p) + more for p in at for more in (0, 1)])).alias("rank")
    asked = sizes.select(*keys, "fold_idx", "n", place).filter("rank < n").distinct()
    asked = asked.select(*keys, "fold_idx", F.col("rank").alias("place"), "rank", F.lit(0).cast("long").alias("cell"))

    level = max(0, math.ceil(math.log(max(1, most / cell_rows), radix) - 1e-9))
    while level:
        width = cell_rows * radix ** (level - 1)
        asked = stored(asked)
        counts = rows.groupBy(*keys, blocks.floor_div(F.col("rank"), width).alias("cell"), "stretch").agg(F.count(F.lit(1)).alias("rows"))
        opened = asked.select(*keys, "fold_idx", "cell").distinct()
        children = F.explode(F.sequence(F.col("cell") * radix, F.least((F.col("cell") + 1) * radix - 1, F.lit((most - 1) // width))))
        found = window_counts(counts, opened.select(*keys, "fold_idx", children.alias("cell")), keys, schedule)
        listed = found.withColumn("parent", blocks.floor_div(F.col("cell"), radix)).groupBy(*keys, "fold_idx", "parent").agg(
            F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells")
        )
        joined = asked.join(listed.withColumnRenamed("parent", "cell"), [*keys, "fold_idx", "cell"])
        asked = joined.select(*keys, "fold_idx", "place", _opened(F.col("cells"), F.col("rank")).alias("o")).select(
            *keys, "fold_idx", "place", "o.rank", "o.cell"
        )
        level -= 1

    values = _values(asked, rows, keys, panel, schedule, cell_rows)
    told = sizes.join(values, [*keys, "fold_idx"]).groupBy(asset, "fold_idx", "_c", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    points = []
    for p in at:
        spot = (F.col("n") - 1) * p
        low = F.floor(spot)
        a = F.element_at("m", low)
        b = F.coalesce(F.try_element_at("m", low + 1), a)
        points.append(F.when(spot == low, a).otherwise((low + 1 - spot) * a + (spot - low) * b))
    told = told.select(asset, "fold_idx", "_c", F.array(*points).alias("p"))
    return told.groupBy(asset, "fold_idx").agg(*[F.first(F.when(F.col("_c") == n, F.col("p")), ignorenulls=True).alias(f"{c}__p") for n, c in enumerate(columns)])


def _values(
    asked: DataFrame, rows: DataFrame, keys: Sequence[str], panel: Panel, schedule: Schedule, cell_rows: int
) -> DataFrame:
    """``(*keys, fold_idx, place, value)``: the rows asked for, out of their leaves."""
    asked = stored(asked.withColumn("_part", blocks.floor_div(F.col("fold_idx"), WINDOWS)))
    # New names of columns, as both sides of the grouping below stem from asked.
    needed = asked.select(*[F.col(c).alias(c) for c in (*keys, "cell", "_part")]).distinct()
    leaves = rows.withColumn("cell", blocks.floor_div(F.col("rank"), cell_rows)).join(needed, [*keys, "cell"])
    kind = panel.df.schema[panel.asset].dataType
    result = T.StructType(
        [T.StructField(panel.asset, kind), T.StructField("_c", T.IntegerType()), T.StructField("fold_idx", T.LongType()),
         T.StructField("place", T.LongType()), T.StructField("value", T.DoubleType())]
    )
    name, origin, step, train, expanding = panel.asset, schedule.origin, schedule.step, schedule.train, schedule.mode == "expanding"

    def run(key: tuple, leaf: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        leaf = leaf.sort_values(blocks.POS, kind="stable")
        pos, rank, v = leaf[blocks.POS].to_numpy(), leaf["rank"].to_numpy(), leaf["v"].to_numpy(dtype=float)
        places = places.sort_values("fold_idx")
        fold, out = places["fold_idx"].to_numpy(), np.empty(len(places))
        ends = origin + fold * step + train
        a = np.searchsorted(pos, np.full(len(fold), origin) if expanding else ends - train)
        b = np.searchsorted(pos, ends)
        for k, (i, j, r) in enumerate(zip(a.tolist(), b.tolist(), places["rank"].tolist())):
            out[k] = v[i + np.argpartition(rank[i:j], r)[r]]
        return pd.DataFrame({name: key[0], "_c": key[1], "fold_idx": fold, "place": places["place"].to_numpy(), "value": out})

    by = [*keys, "cell", "_part"]
    return leaves.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, result)
