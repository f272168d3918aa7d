"""Data-quality checks. Each returns its violations; an empty table is a pass.

``enforce`` turns violations into an error. Everything is an aggregate with
partial results, an equi-join or a blocked ``previous``: no check orders a
whole series in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.operators import blocks
from barfold.panel import HOUR, Panel, ntz
from barfold.schema import BOUNDARY_COLUMNS, RUN_KEYS, SPLITS


class QualityError(ValueError):
    """Data that break a check; ``check`` names it and ``offender`` shows the first row."""

    def __init__(self, check: str, offender: str, count: int):
        super().__init__(f"{check} violated {count} time(s); first: {offender}")
        self.check, self.offender, self.count = check, offender, count


def enforce(checks: Mapping[str, DataFrame]) -> None:
    """Raise for the first check, in the given order, that has violations. One job."""
    parts = None
    for n, (name, rows) in enumerate(checks.items()):
        text = F.to_json(F.struct(*rows.columns))
        part = rows.select(F.lit(n).alias("n"), F.lit(name).alias("check"), text.alias("row"))
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return
    found = (
        parts.groupBy("n", "check")
        .agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("count"))
        .orderBy("n")
        .first()
    )
    if found is not None:
        raise QualityError(found["check"], found["row"], found["count"])


# -- grids -------------------------------------------------------------------


def grid_holes(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    seconds: int = HOUR,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Neighbouring rows not exactly one grid step apart, with the step between them."""
    slim = df.select(*keys, time).withColumn(blocks.POS, blocks.grid_position(time, seconds))
    paired = blocks.previous(slim, keys, {"before": time}, block_rows=block_rows)
    apart = (
        F.unix_micros(F.col(time).cast("timestamp"))
        - F.unix_micros(F.col("before").cast("timestamp"))
    ) / F.lit(seconds * 1_000_000)
    return (
        paired.filter(F.col("before").isNotNull())
        .withColumn("steps", apart)
        .filter(F.col("steps") != 1)
        .select(*keys, "before", F.col(time).alias("after"), "steps")
    )


def contiguous(rows: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "split"), **options) -> DataFrame:
    """Holes in stored forecast rows."""
    return grid_holes(rows, keys, "timestamp", **options)


def hourly_grid(panel: Panel, *, seconds: int = HOUR, **options) -> DataFrame:
    """Per asset the number of holes and the first one with its neighbours."""
    holes = grid_holes(panel.df, [panel.asset], panel.time, seconds=seconds, **options)
    return holes.groupBy(panel.asset).agg(
        F.count(F.lit(1)).alias("n_holes"),
        F.min("before").alias("first_before"),
        F.min_by("after", "before").alias("first_after"),
    )


def grid_shape(panel: Panel, *, seconds: int = HOUR) -> DataFrame:
    """Assets whose row count differs from their span, or with times off the grid or
    repeated rows. Cheaper than ``hourly_grid``: one aggregate, no order."""
    pos = blocks.grid_position(panel.time, seconds)
    off = blocks.grid_time(pos, seconds) != F.col(panel.time)
    cells = panel.df.groupBy(panel.asset, pos.alias(blocks.POS)).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(off).alias("_off")
    )
    return (
        cells.groupBy(panel.asset)
        .agg(
            F.min(blocks.POS).alias("_first"),
            F.max(blocks.POS).alias("_last"),
            F.count(F.lit(1)).alias("n_points"),
            F.sum("_n").alias("n_rows"),
            F.sum("_off").alias("n_off_grid"),
        )
        .withColumn("n_expected", F.col("_last") - F.col("_first") + 1)
        .drop("_first", "_last")
        .filter(
            (F.col("n_points") != F.col("n_expected"))
            | (F.col("n_rows") != F.col("n_points"))
            | (F.col("n_off_grid") > 0)
        )
    )


def verify_grid(panel: Panel, seconds: int = HOUR) -> Panel:
    """The panel with its grid stated, after checking it; raises with the first hole."""
    bad = grid_shape(panel, seconds=seconds).first()
    if bad is not None:
        enforce({"hourly grid": hourly_grid(panel, seconds=seconds)})
        raise QualityError("hourly grid", str(bad.asDict()), 1)
    return panel.on_grid(seconds)


# -- assets ------------------------------------------------------------------


def asset_summary(panel: Panel) -> DataFrame:
    """First and last usable time and row count per asset."""
    return panel.df.groupBy(panel.asset).agg(
        F.min(panel.time).alias("first_usable_ts"),
        F.max(panel.time).alias("last_usable_ts"),
        F.count(F.lit(1)).alias("n_usable_rows"),
    )


_SUMMARY = ("first_usable_ts", "last_usable_ts", "n_usable_rows")


def _differs(table: DataFrame, reference: Mapping) -> Column:
    same = F.lit(True)
    for name in _SUMMARY:
        want = reference[name]
        want = ntz(want) if isinstance(want, datetime) else F.lit(want)
        same = same & (F.col(name) == want)
    return ~same


def assets_agree(panel: Panel) -> DataFrame:
    """Assets whose span or row count differs from that of the first asset by name.

    All assets share one table and hence the same columns.
    """
    table = asset_summary(panel)
    reference = table.orderBy(panel.asset).first()
    if reference is None:
        return table
    return table.filter(_differs(table, reference.asDict()))


def asset_precondition(panel: Panel, asset: str, reference: Mapping) -> DataFrame:
    """Deviations of one asset from a verified summary; an unknown asset deviates too."""
    known = panel.df.sparkSession.createDataFrame([(asset,)], f"{panel.asset} string")
    one = asset_summary(
        Panel(panel.df.filter(F.col(panel.asset) == asset), asset=panel.asset, time=panel.time)
    )
    joined = known.join(one, panel.asset, "left")
    return joined.filter(F.coalesce(_differs(joined, reference), F.lit(True)))


def check_lookbacks(lookbacks: Mapping[str, int], ceiling: int) -> None:
    """No model may look back further than the calendar allows for."""
    if not lookbacks:
        raise ValueError("no models given")
    over = {k: v for k, v in lookbacks.items() if v > ceiling}
    if over:
        raise ValueError(f"lookback beyond the ceiling of {ceiling}: {over}")


def check_target(panel: Panel, target: str) -> None:
    if target not in panel.label_cols:
        raise ValueError(f"target {target!r} is not a label; labels are {panel.label_cols}")


def check_features(panel: Panel, columns: Sequence[str], tag: str, frozen: Mapping | None) -> None:
    """The panel has exactly the agreed features, and the stored tag is the same."""
    if panel.feature_cols != list(columns):
        raise ValueError(
            f"feature columns {panel.feature_cols} differ from the agreed {list(columns)}"
        )
    if frozen is not None and frozen.get("tag") != tag:
        raise ValueError(f"feature tag {tag} differs from the stored {frozen.get('tag')}")


# -- stored forecasts --------------------------------------------------------


def split_agrees(rows: DataFrame, expected: str = "partition_split") -> DataFrame:
    """Rows whose ``split`` is not the one of the place they are stored in."""
    return rows.filter(~F.col("split").eqNullSafe(F.col(expected)))


def known_split(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def unique_timestamps(rows: DataFrame, keys: Sequence[str] = (*RUN_KEYS, "split")) -> DataFrame:
    """Timestamps stored more than once within a half."""
    return (
        rows.groupBy(*keys, "timestamp")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def _half(rows: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("split") == split).groupBy(*keys).agg(
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def oos_tiling(
    rows: DataFrame, cut: datetime, last: datetime, horizon: int,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Runs whose out-of-sample rows do not reach from the cut to the last time in
    whole horizons. Holes inside are ``contiguous``'s."""
    half = _half(rows, "oos", keys)
    return half.filter(
        (F.col("first_ts") != ntz(cut))
        | (F.col("last_ts") != ntz(last))
        | (F.col("n_rows") % horizon != 0)
    )


def insample_coverage(
    rows: DataFrame, cut: datetime, horizon: int, keys: Sequence[str] = RUN_KEYS,
    *, seconds: int = HOUR,
) -> DataFrame:
    """Runs whose in-sample rows do not end one step before the cut in whole horizons."""
    half = _half(rows, "in_sample", keys)
    before = blocks.grid_time(blocks.grid_position(ntz(cut), seconds) - 1, seconds)
    return half.filter((F.col("last_ts") != before) | (F.col("n_rows") % horizon != 0))


def halves_disjoint(
    rows: DataFrame, cut: datetime, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Runs whose halves overlap: rows on the wrong side of the cut, or shared times."""
    sides = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "in_sample", F.col("timestamp"))).alias("last_in_sample"),
        F.min(F.when(F.col("split") == "oos", F.col("timestamp"))).alias("first_oos"),
    )
    both = rows.groupBy(*keys, "timestamp").agg(
        F.count_if(F.col("split") == "in_sample").alias("_in"),
        F.count_if(F.col("split") == "oos").alias("_out"),
    ).filter((F.col("_in") > 0) & (F.col("_out") > 0))
    shared = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared"))
    joined = sides.join(shared, list(keys), "left").withColumn(
        "n_shared", F.coalesce("n_shared", F.lit(0))
    )
    ok = (F.col("last_in_sample") < ntz(cut)) & (F.col("first_oos") >= ntz(cut))
    return joined.filter(~F.coalesce(ok, F.lit(False)) | (F.col("n_shared") > 0))


def embargo(folds: DataFrame, horizon: int, *, seconds: int = HOUR) -> DataFrame:
    """Folds whose last training label is closer to the test window than the horizon."""
    gap = blocks.grid_position("test_start", seconds) - blocks.grid_position(
        "last_train_label_ts", seconds
    )
    return folds.withColumn("gap", gap).filter(F.col("gap") < horizon)


def dual_key_folds(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Folds with rows but no fold entry, or the reverse."""
    ids = [*keys, "split", "fold_idx"]
    stored, listed = rows.select(*ids).distinct(), folds.select(*ids).distinct()
    return (
        stored.exceptAll(listed).withColumn("missing_in", F.lit("folds"))
        .unionByName(listed.exceptAll(stored).withColumn("missing_in", F.lit("rows")))
    )


def dual_key_steps(rows: DataFrame, horizon: int, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Folds whose steps are not exactly ``0 .. horizon-1``."""
    return (
        rows.groupBy(*keys, "split", "fold_idx")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("step").alias("n_steps"),
            F.min("step").alias("first_step"),
            F.max("step").alias("last_step"),
        )
        .filter(
            (F.col("n_rows") != horizon)
            | (F.col("n_steps") != horizon)
            | (F.col("first_step") != 0)
            | (F.col("last_step") != horizon - 1)
        )
    )


def dual_key_times(
    rows: DataFrame, folds: DataFrame, keys: Sequence[str] = RUN_KEYS, *, seconds: int = HOUR
) -> DataFrame:
    """Rows not stamped ``test_start + step``."""
    ids = [*keys, "split", "fold_idx"]
    joined = rows.join(folds.select(*ids, "test_start"), ids)
    want = blocks.grid_time(
        blocks.grid_position("test_start", seconds) + F.col("step"), seconds
    )
    return joined.withColumn("expected", want).filter(F.col("timestamp") != F.col("expected")).select(
        *ids, "step", "timestamp", "expected"
    )


def unique_folds(folds: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return (
        folds.groupBy(*keys, "fold_idx", "split")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def writable_folds(
    rows: DataFrame, boundaries: DataFrame, horizon: int, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Folds that may not be stored: not ``horizon`` rows, or not on the calendar.

    ``boundaries`` has ``split, fold_idx``; an unknown split is on no calendar.
    """
    sized = rows.groupBy(*keys, "split", "fold_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    scheduled = boundaries.select("split", "fold_idx", F.lit(True).alias("_known"))
    joined = sized.join(scheduled, ["split", "fold_idx"], "left").withColumn(
        "scheduled", F.coalesce("_known", F.lit(False))
    )
    return joined.filter((F.col("n_rows") != horizon) | ~F.col("scheduled")).select(
        *keys, "split", "fold_idx", "n_rows", "scheduled"
    )


def calendar_identity(folds: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Fold entries on which the runs do not all agree."""
    runs = folds.select(*keys).distinct().count()
    edges = F.struct(*[c for c in BOUNDARY_COLUMNS if c not in ("fold_idx", "split")])
    return (
        folds.groupBy("split", "fold_idx")
        .agg(
            F.count_distinct(edges).alias("n_versions"),
            F.count_distinct(F.struct(*keys)).alias("n_runs"),
        )
        .filter((F.col("n_versions") != 1) | (F.col("n_runs") != runs))
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def store_checks(
    rows: DataFrame, folds: DataFrame, *, cut: datetime, last: datetime, horizon: int
) -> dict[str, DataFrame]:
    """All checks on one or more complete runs, in the order they are reported."""
    return {
        "split agrees": known_split(rows),
        "unique timestamps": unique_timestamps(rows),
        "contiguous": contiguous(rows),
        "oos tiling": oos_tiling(rows, cut, last, horizon),
        "in-sample coverage": insample_coverage(rows, cut, horizon),
        "halves disjoint": halves_disjoint(rows, cut),
        "unique folds": unique_folds(folds),
        "embargo": embargo(folds, horizon),
        "dual key: folds": dual_key_folds(rows, folds),
        "dual key: steps": dual_key_steps(rows, horizon),
        "dual key: times": dual_key_times(rows, folds),
    }
