"""Results that must not depend on block sizes, levels of values or names of assets."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.operators import backtest, ledger
from barfold.sources import bars as sources


@pytest.mark.parametrize("block_rows", [10, 16, 16384])
def test_forecast_accuracy_counts_folds_that_are_there(spark, block_rows):
    folds = [f * 4 for f in range(20)]
    rows = [("a", f, float(f), 0.0) for f in folds]
    df = spark.createDataFrame(rows, "asset string, fold_idx long, forecast double, actual double")
    got = {r.fold_idx: r.forecast_accuracy for r in ledger.forecast_accuracy(df, folds=3, block_rows=block_rows).collect()}
    assert got == {f: (float(np.mean(folds[max(0, k - 3) : k])) if k else 0.0) for k, f in enumerate(folds)}


@pytest.mark.parametrize("reach", [None, 1])
def test_previous_value_over_holes(spark, reach):
    places = [*range(8), *range(12, 20)]
    df = spark.createDataFrame([("a", p, float(p + 1)) for p in places], "asset string, p long, v double")
    seen = []
    for block_rows in (4, 6, 16384):
        out = backtest.previous_value(df, ["asset"], "v", "before", F.col("p"), reach=reach, block_rows=block_rows)
        seen.append({r.p: r.before for r in out.collect()})
    at_hole = 8.0 if reach is None else 0.0
    assert seen[0] == seen[1] == seen[2] == {p: at_hole if p == 12 else (float(p) if p else 0.0) for p in places}


def test_numeric_asset_names_come_back(spark, tmp_path):
    rows = [(name, dt.datetime(2024, 1, 1, h), *[1.0 + h] * 5) for name in ("0700", "1e3") for h in range(3)]
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, open double, high double, low double, close double, volume double")
    sources.write_bars(df, str(tmp_path / "bars"))
    assert sources.asset_names(sources.read_bar_table(spark, str(tmp_path / "bars"))) == ["0700", "1e3"]


@pytest.mark.parametrize("train, step", [(12, 5), (30, 24), (7, 3)])
def test_contexts_go_by_rows_over_holes(spark, train, step):
    from barfold.operators import samples
    from barfold.operators.calendar import Schedule
    from barfold.panel import Panel

    start = dt.datetime(2024, 1, 1)
    gone = {3, 4, 20, 21, 22, 23, 24, 25, 26, 27, 28, 40, 41, 65}
    places = {"a": [p for p in range(90) if p not in gone], "b": [*range(33, 80, 2)]}
    rows = [(a, start + dt.timedelta(hours=p), float(p), float(-p)) for a, ps in places.items() for p in ps]
    panel = Panel(spark.createDataFrame(rows, "asset string, time timestamp_ntz, x double, z double"), ("x", "z"), ())
    schedule = Schedule(start, train, 6, step, 12)
    lookback = 9
    got = {(r.asset, r.fold_idx): [v[0] for v in r.x] for r in samples.sequence_context(panel, schedule, lookback).collect()}
    want = {}
    first = {}
    for a, ps in places.items():
        for f in range(12):
            mine = [float(p) for p in ps if f * step <= p < f * step + train][-lookback:]
            if mine:
                want[a, f] = mine
            test = [float(p) for p in ps if f * step + train <= p < f * step + train + 6]
            if test:
                first[a, f] = test[0]
    assert got == want
    assert {(r.asset, r.fold_idx): r.x[0] for r in samples.tabular_context(panel, schedule).collect()} == first


@pytest.mark.parametrize("mode", ["sliding", "expanding"])
@pytest.mark.parametrize("train, step", [(12, 5), (30, 24), (7, 3), (10, 5)])
def test_places_in_folds_over_holes(spark, mode, train, step):
    """Row numbers of windows, trims by rows, last labels and inner splits, by brute force."""
    from barfold.operators import folds, samples
    from barfold.operators.calendar import Schedule
    from barfold.panel import Panel

    start = dt.datetime(2024, 1, 1)
    gone = {3, 4, *range(20, 29), 40, 41, 65}
    places = {"a": [p for p in range(-9, 90) if p not in gone], "b": [*range(33, 80, 2)]}
    rows = [(a, start + dt.timedelta(hours=p), float(p)) for a, ps in places.items() for p in ps]
    panel = Panel(spark.createDataFrame(rows, "asset string, time timestamp_ntz, x double"), ("x",), ())
    schedule = Schedule(start, train, 6, step, 12, mode)
    mine = {}
    for a, ps in places.items():
        for f in range(12):
            inside = [p for p in ps if (0 if mode == "expanding" else f * step) <= p < f * step + train]
            if inside:
                mine[a, f] = inside
    got = {(r.asset, r.fold_idx): (r._first, r._last) for r in folds.window_rows(panel, schedule).collect()}
    assert got == {(a, f): (places[a].index(w[0]), places[a].index(w[-1])) for (a, f), w in mine.items()}

    horizon = 5
    kept = {k: (w[:-horizon] if len(w) > horizon else w) for k, w in mine.items()}
    assigned = folds.assign_folds(panel, schedule)
    out = {}
    for r in folds.embargo_trim_rows(assigned, "asset", horizon).filter("role = 'train'").collect():
        out.setdefault((r.asset, r.fold_idx), []).append(int(r.x))
    assert {k: sorted(v) for k, v in out.items()} == kept
    last = {(r.asset, r.fold_idx): r.last_train_label_ts for r in folds.last_train_label(panel, schedule, horizon).collect()}
    assert last == {k: start + dt.timedelta(hours=w[-1]) for k, w in kept.items()}

    parts = {}
    for r in samples.inner_split(assigned, "asset", 2, 3, 0.4).collect():
        parts.setdefault((r.asset, r.fold_idx), {})[int(r.x)] = r.part
    for k, w in mine.items():
        size = samples.inner_split_size(len(w), 2, 3, 0.4) or 0
        assert parts[k] == {p: "val" if n >= len(w) - size else "train" for n, p in enumerate(w)}


def test_rows_are_numbered_over_a_heavy_day(spark):
    """A day with most rows is cut into many ranges; ties by time go by the next column."""
    df = spark.range(0, 60_000, 1, 16).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS asset",
        "timestamp_ntz '2024-01-01' + make_dt_interval(CAST(if(id % 10 < 8, 3, id % 7) AS INT), 0, 0, CAST(hash(id) % 40 AS DECIMAL(18, 6))) AS time", "id",
    )
    from barfold.operators import blocks

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = df.orderBy("asset", "time", "id").filter("asset = 'a' AND dayofmonth(time) = 4")
        assert ordered.select(F.spark_partition_id()).distinct().count() > 1
        out = blocks.rank_positions(df, ["asset"], ["time", "id"], out="n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    seen = out.toPandas().sort_values(["asset", "time", "id"], na_position="first")
    want = seen.groupby("asset", dropna=False).cumcount()
    assert len(seen) == 60_000 and (seen.n == want).all()


def test_time_ranges_reach_the_scan_below_features(spark, tmp_path):
    """The scan is filtered as far as the transforms reach; values are those of the whole series."""
    from barfold.functions.features import apply_features
    from barfold.panel import Panel
    from tests.conftest import bar_frame, to_spark

    to_spark(spark, bar_frame(rows=4_000)).write.parquet(str(tmp_path / "bars"))
    panel = Panel(spark.read.parquet(str(tmp_path / "bars"))).on_grid()
    whole = apply_features(panel).on_grid()
    first, last = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 3)
    part = whole.slice_time(first, last)
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(time,2024-0" in pushed and "LessThan" in pushed
    cut = whole.df.filter((F.col("time") >= F.lit(first)) & (F.col("time") < F.lit(last)))
    a, b = (d.toPandas().sort_values(["asset", "time"]).reset_index(drop=True) for d in (part.df, cut))
    assert len(a) == 2 * 48 and part.grid_seconds == 3600 and part.feature_cols == whole.feature_cols
    np.testing.assert_allclose(a.drop(columns=["asset", "time"]).to_numpy(float), b.drop(columns=["asset", "time"]).to_numpy(float), rtol=1e-9, atol=1e-12)
    assert (a.time == b.time).all()
    same = whole.clip_inclusive("2024-05-01", "2024-05-02 23:00:00").df
    assert same.exceptAll(part.df).isEmpty() and same.count() == len(a)
    # A changed table is cut by a plain filter.
    more = whole.add_features({"twice": F.col("close") * 2}).slice_time(first, last)
    assert more.df.count() == len(a) and "twice" in more.feature_cols
