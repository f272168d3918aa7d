from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barfold.operators import quality
from barfold.operators.calendar import Calendar, Geometry
from barfold.operators.models import RidgeSequence
from barfold.plans.context import ModelSpec, run_context
from barfold.plans.produce import produce_forecasts
from barfold.panel import Panel
from barfold.sources import events as ev
from barfold.sources import bars as files
from barfold.sources import store as st
from tests.conftest import bar_frame, to_spark

HEADER = "open_time_iso,open,high,low,close,volume,funding_rate\n"


@pytest.fixture
def folder(tmp_path):
    for name in ("BBB", "AAA", "_skip"):
        rows = [f"2024-01-01T0{h}:00:00+00:00,1,2,0.5,{h + 1},10,0.1\n" for h in (2, 0, 1)]
        (tmp_path / f"{name}.csv").write_text(HEADER + "".join(rows))
    return str(tmp_path)


def test_scan_assets(spark, folder):
    panel = files.scan_assets(spark, folder)
    assert files.asset_names(panel) == ["AAA", "BBB"]
    rows = panel.df.filter("asset = 'AAA'").orderBy("time").collect()
    assert [r.close for r in rows] == [1.0, 2.0, 3.0]
    assert rows[0].time == datetime(2024, 1, 1)
    assert quality.verify_grid(panel).grid_seconds == 3600


def test_read_bars_options(spark, folder):
    path = folder + "/AAA.csv"
    uni = files.read_bars(spark, path, preset="univariate")
    assert uni.df.columns == ["asset", "time", "close"] and uni.feature_cols == ["close"]
    picked = files.read_bars(spark, path, preset="univariate", use_cols=["volume", "volume", "nope"])
    assert picked.df.columns == ["asset", "time", "volume"]
    assert files.read_bars(spark, path, features=["volume"]).feature_cols == ["volume"]
    with pytest.raises(ValueError, match="preset"):
        files.read_bars(spark, path, preset="other")
    with pytest.raises(ValueError, match="time column"):
        files.read_bars(spark, path, time_col="when")


def test_columns_go_by_header(spark, tmp_path):
    """Other orders, more and fewer columns, quoted and odd names, an empty file and a header alone."""
    texts = {
        "A": "open_time_iso,open,high,low,close,volume\n2024-01-01T00:00:00+00:00,1,2,3,4,5\n",
        "B": "volume,close,extra,low,open_time_iso,high,open\n5,4,x,3,2024-01-01T00:00:00+00:00,2,1\n",
        "C+1 [x]": 'close,"open_time_iso"\n4,2024-01-01T00:00:00+00:00\n',
        "D%20é": "\ufeffopen_time_iso,close,close\n2024-01-01T00:00:00+00:00,4,99\n",
        "E": "",
        "F": "open_time_iso,close\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    # One group has two files.
    (tmp_path / "G.csv").write_text(texts["A"])
    panel = files.scan_assets(spark, str(tmp_path))
    got = {r.asset: (r.open, r.high, r.low, r.close, r.volume) for r in panel.df.collect()}
    whole = (1.0, 2.0, 3.0, 4.0, 5.0)
    assert got["A"] == got["B"] == got["G"] == whole
    rest = {k: v for k, v in got.items() if k not in "ABG"}
    assert len(rest) == 2 and set(rest.values()) == {(None, None, None, 4.0, None)}
    assert len({r.time for r in panel.df.collect()}) == 1
    heads = files.file_headers(spark, [str(tmp_path)])
    assert len(heads) == 5 and len(heads[("open_time_iso", "open", "high", "low", "close", "volume")]) == 2

    named = files.read_bars(spark, str(tmp_path / "B.csv"), features=["close", "extra"], time_col="open_time_iso")
    assert named.df.columns == ["asset", "time", "open", "high", "low", "close", "volume", "extra"]
    uni = files.read_bars(spark, str(tmp_path / "C+1 ?x?.csv"), preset="univariate").df
    assert [tuple(r)[2:] for r in uni.collect()] == [(4.0,)] and uni.columns == ["asset", "time", "close"]
    only = files.read_bars(spark, str(tmp_path / "B.csv"), use_cols=["volume", "nope"]).df
    assert only.columns == ["asset", "time", "volume"]


def test_raw_files(spark, tmp_path):
    place = tmp_path / "AAA"
    place.mkdir()
    tail = ",0,0,0,0,0,0\n"
    (place / "k-1.csv").write_text("1704067200000,1,2,0.5,1.5,10" + tail + "1704067200000,9,9,9,9,9" + tail)
    (place / "k-2.csv").write_text(
        "open_time,open,high,low,close,volume,a,b,c,d,e,f\n1704067200000000,8,8,8,8,8" + tail
        + "1704070800000000,1,2,0.5,1.7,11" + tail
    )
    raw = files.read_raw(spark, str(place / "*.csv"), files.schema.KLINE_COLUMNS)
    got = files.normalize_klines(raw).orderBy("time").collect()
    assert [(r.asset, r.time.hour, r.close) for r in got] == [("AAA", 0, 1.5), ("AAA", 1, 1.7)]


def test_hours_of_many_series_are_laid_out_by_many_tasks(spark, monkeypatch):
    """The series are few rows, their hours many: checks that need times alone must not run in one task."""
    monkeypatch.setattr(ev, "TASK_ROWS", 1000, raising=False)
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    events = spark.range(80).select(
        F.col("id").alias("event_id"), (start + F.make_dt_interval(hours=F.when(F.col("id") < 40, 0).otherwise(99))).alias("ts"),
        (F.col("id") % 40 * 50).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
    )
    panel = ev.hourly_bars(events)

    def size(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(b.num_rows for b in batches)], pa.int64())})

    rows = [r.n for r in panel.df.select("asset", "time").mapInArrow(size, "n long").collect()]
    assert sum(rows) == 40 * 100 and max(rows) <= 2500, rows
    assert quality.grid_shape(panel).isEmpty() and quality.hourly_grid(panel).isEmpty()


def test_panel_roles(bars):
    panel = bars[1].add_features({"x": F.col("close") * 2}).add_labels({"y": F.col("close")})
    assert (panel.feature_cols, panel.label_cols) == (["x"], ["y"])
    gone = panel.remove_features(["x", "absent"])
    assert gone.feature_cols == [] and "x" not in gone.df.columns
    assert len(panel) == 800 and panel.shape[0] == 800 and not panel.empty
    assert "rows=800" in panel.describe()
    with pytest.raises(ValueError, match="not found"):
        Panel(panel.df, time="when")


# -- store ------------------------------------------------------------------------

GEOMETRY = Geometry(72, 12, 12, 24, 12)
FIRST = datetime(2024, 1, 1)
CAL = Calendar(FIRST, FIRST + timedelta(hours=239), 0.5, GEOMETRY, 10)
RUN = ("a", "m", 0)


def _tables(spark, run=RUN):
    rows, folds = [], []
    for split, name in (("oos", "oos"), ("in_sample", "in_sample_dense")):
        s = CAL.schedule(name)
        for j in range(s.n_folds):
            a, b = s.at(j * s.step), s.at(j * s.step + s.train)
            folds.append((*run, j, split, a, b, b - timedelta(hours=13), b, b + timedelta(hours=12), 0.1, None, False))
            for h in range(12):
                rows.append((*run, split, j, b + timedelta(hours=h), h, 0.5, 0.25))
    return spark.createDataFrame(rows, st.schema.FORECASTS), spark.createDataFrame(folds, st.schema.FOLDS)


def test_life_of_a_run(spark, tmp_path):
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    rows, folds = _tables(spark)
    with pytest.raises(st.StoreError, match="no status"):
        kept.load_unit(RUN)
    kept.begin([RUN])
    empty = kept.load_unit(RUN, allow_incomplete=True)
    assert empty["rows"].isEmpty() and empty["status"]["status"] == "running"
    with pytest.raises(st.StoreError, match="no folds"):
        kept.finalize([RUN], CAL)
    kept.write_forecasts(rows)
    kept.write_folds(folds)
    with pytest.raises(st.StoreError, match="not 'complete'"):
        kept.load_unit(RUN)
    kept.finalize([RUN], CAL, {RUN: {"note": 1}})
    unit = kept.load_unit(RUN)
    assert unit["rows"].count() == rows.count() and unit["meta"]["note"] == 1
    assert unit["status"]["n_rows_oos"] == CAL.oos_rows
    # A second run is kept when the first begins again and fails.
    other = ("b", "m", 0)
    more = _tables(spark, other)
    kept.begin([other])
    kept.write_forecasts(more[0])
    kept.write_folds(more[1])
    kept.finalize([other], CAL)
    kept.begin([RUN])
    kept.fail([RUN], RuntimeError("boom"))
    status = {r.asset: r for r in kept.status([RUN, other]).collect()}
    assert status["a"].status == "failed" and "boom" in status["a"].error
    assert status["b"].status == "complete" and kept.read_forecasts([RUN]).isEmpty()
    assert kept.load_units([other])[0].count() == rows.count()


def test_a_writer_that_dies_anywhere_leaves_one_whole_run(spark, tmp_path):
    """Readers see the first attempt of a run after each step of the second, and the third once its last step is done."""
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    rows, folds = _tables(spark)
    n_rows, n_folds = rows.count(), folds.count()

    def steps(value, note):
        yield lambda: kept.begin([RUN])
        yield lambda: kept.write_forecasts(rows.withColumn("forecast", F.lit(value)).filter("split = 'oos'"))
        yield lambda: kept.write_forecasts(rows.withColumn("forecast", F.lit(value)))
        yield lambda: kept.write_folds(folds)
        yield lambda: kept.write_meta({RUN: {"note": note}})
        yield lambda: kept.finalize([RUN], CAL, {RUN: {"note": note}})

    def seen():
        unit = kept.load_unit(RUN)
        values = [r.forecast for r in unit["rows"].select("forecast").collect()]
        assert len(values) == n_rows and len(unit["folds"].collect()) == n_folds
        assert unit["status"]["status"] == "complete" and len(set(values)) == 1
        return values[0], unit["meta"]["note"]

    for step in steps(1.0, "first"):
        step()
    assert seen() == (1.0, "first")
    # A writer that dies after a step leaves the store as it is then.
    for step in list(steps(2.0, "again"))[:-1]:
        step()
        assert seen() == (1.0, "first")
    kept.fail([RUN], RuntimeError("lost"))
    assert seen() == (1.0, "first") and kept.status([RUN]).first().status == "failed"
    for step in steps(9.0, "last"):
        step()
    assert seen() == (9.0, "last")
    assert len(kept.clean()) == 2 and seen() == (9.0, "last")


def test_files_of_a_write_do_not_grow_with_its_runs(spark, tmp_path):
    """Many runs share files; a later write of one run and half replaces that alone."""
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    rows, folds = _tables(spark)
    runs = [(f"a{n:02d}", "m", 0) for n in range(70)]
    names = spark.createDataFrame([(r[0],) for r in runs], "asset string")
    many, edges = (t.drop("asset").crossJoin(names) for t in (rows, folds))
    kept.begin(runs)
    kept.write_forecasts(many)
    kept.write_folds(edges)
    files = list((tmp_path / "s" / "forecasts").rglob("part-*.parquet"))
    assert 0 < len(files) <= 8
    again = many.filter("asset = 'a07' AND split = 'oos'").withColumn("forecast", F.lit(9.0))
    kept.write_forecasts(again)
    kept.finalize(runs, CAL)
    got, got_folds = kept.load_units(runs)
    assert got.count() == 70 * rows.count() and got_folds.count() == 70 * folds.count()
    nine = got.filter("forecast = 9.0").select("asset", "split").distinct().collect()
    assert nine == [("a07", "oos")] and got.filter("forecast = 9.0").count() == again.count()
    one = kept.load_unit(("a07", "m", 0))
    assert one["rows"].count() == rows.count() and one["status"]["n_rows_oos"] == CAL.oos_rows


def test_rows_of_an_unknown_half_are_not_lost_while_reading(spark, tmp_path):
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    kept.begin([RUN])
    kept.write_forecasts(_tables(spark)[0].withColumn("split", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="unknown half: NULL"):
        kept.read_forecasts([RUN]).collect()


def test_rows_of_a_run_that_was_not_begun_are_refused(spark, tmp_path):
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    kept.begin([("other", "m", 0)])
    with pytest.raises(Exception, match="run was not begun: a / m / 0"):
        kept.write_forecasts(_tables(spark)[0])


def test_broken_rows_are_not_completed(spark, tmp_path):
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    rows, folds = _tables(spark)
    late = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    odd = (F.col("split") == "oos") & (F.col("fold_idx") == 2)
    kept.begin([RUN])
    kept.write_forecasts(rows.withColumn("timestamp", F.when(odd, late).otherwise(F.col("timestamp"))))
    kept.write_folds(folds)
    with pytest.raises(quality.QualityError, match="unique timestamps"):
        kept.finalize([RUN], CAL)
    assert kept.status([RUN]).first().status == "running"


def test_config_and_meta_guards(spark, tmp_path):
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    kept.write_config_once({"calendar": {"a": 1}})
    kept.write_config_once({"calendar": {"a": 1}, "more": {"b": [1, 2]}})
    with pytest.raises(st.StoreError, match="differs"):
        kept.write_config_once({"calendar": {"a": 2}})
    with pytest.raises(st.StoreError, match="the run is"):
        kept.write_meta({RUN: {"asset": "zzz"}})


def test_packets_need_a_fold_entry(spark):
    rows, folds = _tables(spark)
    packets = st.fold_packets(rows, folds).filter("split = 'oos' and fold_idx = 1").first()
    assert len(packets.forecast) == 12 and packets.timestamps == sorted(packets.timestamps)
    lonely = folds.filter("fold_idx <> 1")
    assert st.orphan_folds(rows, lonely).count() == 2
    with pytest.raises(Exception, match="no fold entry"):
        st.fold_packets(rows, lonely).collect()


def test_text_form_is_exact(spark):
    rows, folds = _tables(spark)
    odd = rows.withColumn("forecast", F.lit(0.1) + F.lit(0.2)).withColumn("actual", F.lit(1e-300))
    back = st.rows_from_text(st.rows_as_text(odd))
    assert back.select("forecast", "actual").distinct().collect() == [(0.1 + 0.2, 1e-300)]
    again = st.folds_from_text(st.folds_as_text(folds))
    assert again.exceptAll(folds.select(again.columns)).isEmpty()
    bad = st.folds_as_text(folds).withColumn("val_active", F.lit("maybe"))
    with pytest.raises(Exception, match="val_active is maybe"):
        st.folds_from_text(bad).collect()


def test_join_features_guards(spark, bars):
    panel = bars[1].add_features({"x": F.col("close")})
    rows, _ = _tables(spark)
    assert st.join_features(rows, panel).filter("x is null").isEmpty()
    short = Panel(panel.df.filter("time < '2024-01-08'"), ("x",))
    with pytest.raises(quality.QualityError, match="rows without features"):
        st.join_features(rows, short)
    twice = Panel(panel.df.unionAll(panel.df), ("x",))
    with pytest.raises(quality.QualityError, match="features repeat"):
        st.join_features(rows, twice)


def test_producer_end_to_end(spark, tmp_path):
    pdf = bar_frame(rows=330)
    ctx = run_context(
        Panel(to_spark(spark, pdf)), GEOMETRY, {"seq": ModelSpec(RidgeSequence(), 6)},
        n_trials=2, longest_lookback=10,
    )
    kept = st.ForecastStore(spark, str(tmp_path / "s"))
    runs = produce_forecasts(spark, ctx, kept)
    rows, folds = kept.load_units(runs)
    per_run = ctx.calendar.folds("oos") + ctx.calendar.folds("in_sample_dense")
    assert folds.count() == 2 * per_run and rows.count() == 2 * 12 * per_run
    meta = kept.read_meta(runs[0])
    assert len(meta["hpo"]["trials"]) == 2 and meta["feature_tag"] == ctx.tag
    assert meta["frozen_hps"] in [t["params"] for t in meta["hpo"]["trials"]]
    ctx.check_panel(ctx.panel.__class__(ctx.panel.df.filter("asset = 'a'"), ctx.panel.features, ctx.panel.labels), "a")
    with pytest.raises(ValueError, match="unknown asset"):
        ctx.check_panel(ctx.panel, "zzz")


def test_context_makes_features_once(spark):
    ctx = run_context(Panel(to_spark(spark, bar_frame(rows=330))), GEOMETRY, {"seq": ModelSpec(RidgeSequence(), 6)}, longest_lookback=10)
    assert ctx.panel.df.inputFiles()  # checks, search, fits and folds read them back
    assert "Window" not in ctx.panel.df._jdf.queryExecution().optimizedPlan().toString()


def test_context_refuses_bad_data(spark):
    pdf = bar_frame(rows=330)
    models = {"seq": ModelSpec(RidgeSequence(), 6)}
    with pytest.raises(quality.QualityError, match="hourly grid"):
        run_context(Panel(to_spark(spark, pdf.drop(index=[100]))), GEOMETRY, models, longest_lookback=10)
    late = pdf[(pdf.asset == "a") | (pdf.time > pdf.time.min())]
    with pytest.raises(quality.QualityError, match="assets agree"):
        run_context(Panel(to_spark(spark, late)), GEOMETRY, models, longest_lookback=10)
    with pytest.raises(ValueError, match="ceiling"):
        run_context(Panel(to_spark(spark, pdf)), GEOMETRY, models, longest_lookback=5)
