import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.functions import metrics
from barfold.functions.features import apply_features
from barfold.operators import backtest, blocks, fitting, folds, ledger, normal, quality, selection, tuning, walkforward
from barfold.operators.calendar import Geometry, Schedule, calendar_of
from barfold.operators.models import EstimatorForecaster, Forecaster, RidgeDMS, RidgeSequence
from barfold.operators.moments import Moments
from barfold.operators.scaling import FoldScaler
from barfold.panel import Panel
from tests.conftest import START, bar_frame, to_spark

LITE = [{"name": "LOG_RETURN_1"}, {"name": "LOG_VOLUME"}, {"name": "LOG_RETURN"}]


@pytest.fixture(scope="module")
def panel(bars):
    return apply_features(bars[1], LITE).on_grid()


@pytest.fixture(scope="module")
def schedule(panel):
    first = panel.df.agg(F.min("time")).first()[0]
    return Schedule(first, 120, 12, 12, 8)


# -- scaling -------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_constant_column_scales_to_zero(panel, schedule, method):
    flat = Panel(panel.df.withColumn("log_volume", F.lit(3.0)), panel.features, panel.labels).on_grid()
    rows = folds.assign_folds(flat, schedule)
    out = FoldScaler(method).fit_transform(flat, schedule, 12, rows)
    assert out.agg(F.max(F.abs("log_volume")), F.count_if(F.col("log_volume").isNull())).first() == (0.0, 0)


@pytest.mark.parametrize("mode", ["sliding", "expanding"])
def test_standard_scaler_with_a_mean_far_above_the_spread(panel, mode):
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 12, 8, mode)
    place = F.col("log_volume") * 0 + F.sin(F.unix_timestamp(F.col("time").cast("timestamp")) / 3600)
    high = Panel(panel.df.withColumn("log_volume", place + 1e9), panel.features, panel.labels).on_grid()
    stats = FoldScaler(columns=("log_volume",), scale_labels=False).fit(high, schedule, 0).stats.toPandas()
    hours = np.arange(400) + START.timestamp() / 3600
    for r in stats.itertuples():
        begin = r.fold_idx * 12 if mode == "sliding" else 0
        want = np.sin(hours)[begin : r.fold_idx * 12 + 120]
        assert abs(r.log_volume__scale - want.std()) < 0.02


@pytest.mark.parametrize("mode", ["sliding", "expanding"])
def test_standard_scaler_of_a_drifting_level(panel, mode):
    """Level 0 for a while, then 1e9 with a spread of 0.7: the far level cancels nothing."""
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 12, 20, mode)
    hour = F.unix_timestamp(F.col("time").cast("timestamp")) / 3600
    place = F.sin(hour) + F.when(F.col("time") < F.lit(schedule.at(150)), 0.0).otherwise(1e9)
    moved = Panel(panel.df.withColumn("log_volume", place), panel.features, panel.labels).on_grid()
    stats = FoldScaler(columns=("log_volume",), scale_labels=False).fit(moved, schedule, 0).stats.toPandas()
    hours = np.arange(400) + first.timestamp() / 3600
    values = np.sin(hours) + np.where(np.arange(400) < 150, 0.0, 1e9)
    for r in stats.itertuples():
        want = values[r.fold_idx * 12 if mode == "sliding" else 0 : r.fold_idx * 12 + 120]
        np.testing.assert_allclose([r.log_volume__center, r.log_volume__scale], [want.mean(), want.std()], rtol=1e-6)
    late = [r.log_volume__scale for r in stats.itertuples() if r.fold_idx * 12 >= 150]
    assert len(late) == 0 if not len(stats) else all(0.6 < v < 0.8 for v in late) == (mode == "sliding")


@pytest.mark.parametrize("mode, train, step, cell_rows, radix", [("sliding", 120, 12, 40, 3), ("expanding", 50, 7, 16, 2), ("sliding", 9, 24, 1000, 64), ("expanding", 120, 12, 7, 50)])
def test_percentiles_of_windows_equal_those_of_copied_rows(spark, mode, train, step, cell_rows, radix):
    """Ties, NULLs, a column of NULLs, holes and assets of other lengths; trees of none to several levels."""
    rng = np.random.default_rng(step)
    rows = []
    for asset, n in (("a", 400), ("b", 150), ("c", 1)):
        for p in range(n):
            if asset != "b" or p % 5:
                x = float(rng.integers(0, 6)) if p % 9 else None
                rows.append((asset, START + pd.Timedelta(hours=p - 20).to_pytimedelta(), x, float(rng.normal()), None))
    df = spark.createDataFrame(rows, "asset string, time timestamp_ntz, x double, y double, z double")
    panel, schedule = Panel(df, ("x", "y", "z")), Schedule(START, train, 6, step, 30, mode)
    hit = folds.assign_folds(panel, schedule, (folds.TRAIN,))
    want = hit.groupBy("asset", "fold_idx").agg(*[F.percentile(c, [0.25, 0.5, 0.75, 1.0]).alias(f"{c}__p") for c in "xyz"])
    done = selection.window_percentiles(panel, schedule, ["x", "y", "z"], [0.25, 0.5, 0.75, 1.0], cell_rows=cell_rows, radix=radix)
    told = {(r.asset, r.fold_idx): r for r in done.collect()}
    assert len(told) > 30 or train == 9
    for r in want.collect():
        if r.x__p is None and r.y__p is None:
            continue
        got = told.pop((r.asset, r.fold_idx))
        for c in ("x__p", "y__p", "z__p"):
            assert (got[c] is None) == (r[c] is None)
            if r[c] is not None:
                np.testing.assert_allclose(got[c], r[c], rtol=1e-12, atol=1e-12)
    assert not told


def test_scaler_sees_training_rows_only(panel, schedule):
    def stats(p):
        return FoldScaler().fit(p, schedule, 12).stats.orderBy("asset", "fold_idx").toPandas()

    edge = schedule.at(120 - 12)
    bent = panel.df.withColumn(
        "log_volume", F.when(F.col("time") >= F.lit(edge), 99.0).otherwise(F.col("log_volume"))
    )
    a, b = stats(panel), stats(Panel(bent, panel.features, panel.labels).on_grid())
    pd.testing.assert_frame_equal(a[a.fold_idx == 0], b[b.fold_idx == 0])
    assert not a[a.fold_idx == 1].equals(b[b.fold_idx == 1])


def test_scaler_errors_and_subset(panel, schedule):
    with pytest.raises(ValueError, match="unknown scaling method"):
        FoldScaler("quantile")
    with pytest.raises(RuntimeError, match="fitted"):
        FoldScaler().transform(panel.df)
    fitted = FoldScaler(columns=("log_volume",), scale_labels=False).fit(panel, schedule, 12)
    assert fitted.columns == ("log_volume",)
    rows = folds.assign_folds(panel, schedule).withColumn("prediction", F.lit(1.0))
    assert fitted.inverse_labels(rows, "prediction") is rows


# -- walk-forward ---------------------------------------------------------------------


def _run(panel, schedule, model=None, **options):
    options = {"horizon": 12, "lags": 3} | options
    out = walkforward.walk_forward(panel, schedule, model or RidgeDMS(1.0), **options)
    return out.toPandas().sort_values(["asset", "fold_idx", "step"]).reset_index(drop=True)


def test_folds_per_task_and_partitions_do_not_matter(panel, schedule):
    one = _run(panel, schedule)
    for k in (1, 3):
        pd.testing.assert_frame_equal(one, _run(panel, schedule, folds_per_task=k))
    assert len(one) == 2 * 8 * 12


def test_no_training_label_within_the_embargo(panel, schedule):
    out = _run(panel, schedule)
    start = out[out.step == 0].time
    gap = start - out[out.step == 0].last_train_label_ts
    assert (gap >= pd.Timedelta(hours=12)).all()


def test_future_bars_change_no_forecast(spark, bars, panel, schedule):
    cut = schedule.at(120 + 5 * 12)  # start of the test window of fold 5
    pdf = bars[0].copy()
    pdf.loc[pdf.time > cut, ["close", "volume"]] *= 2
    bent = apply_features(Panel(to_spark(spark, pdf)).on_grid(), LITE).on_grid()
    a, b = _run(panel, schedule), _run(bent, schedule)
    keep = a.fold_idx <= 5
    np.testing.assert_allclose(a[keep].prediction, b[keep].prediction)
    assert not np.allclose(a[~keep].prediction, b[~keep].prediction)


def _by_rows(monkeypatch):
    monkeypatch.setattr(normal, "applies", lambda *a: False)


@pytest.mark.parametrize("method", [None, "standard", "minmax"])
@pytest.mark.parametrize("shape", ["tabular", "picked", "sequence", "unscaled labels"])
def test_expanding_fits_by_moments_equal_fits_by_rows(panel, method, shape, monkeypatch):
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 7, 20, "expanding")
    model = {"picked": RidgeDMS(2.0, ("log_return_lag_2", "log_volume")), "sequence": RidgeSequence(3.0, ("log_volume",))}.get(shape, RidgeDMS(1.0))
    scaler = None if method is None else FoldScaler(method, scale_labels=shape != "unscaled labels")
    options = {"scaler": scaler, "val_ratio": 0.2} | ({"lags": 0, "lookback": 3} if shape == "sequence" else {})
    monkeypatch.setattr(normal, "STRETCHES", 5)
    monkeypatch.setattr(normal, "FOLDS", 3)
    done = _run(panel, schedule, model, **options)
    _by_rows(monkeypatch)
    want = _run(panel, schedule, model, **options)
    assert len(done) == len(want) == 2 * 20 * 12
    pd.testing.assert_frame_equal(done, want, rtol=1e-8, atol=1e-12)


def test_expanding_fits_of_late_and_short_assets(spark, monkeypatch):
    """Series that begin and end within the schedule, and one before its origin."""
    pdf = pd.concat([bar_frame(("a",), 400, 1), bar_frame(("late",), 400, 2).iloc[130:], bar_frame(("short",), 400, 3).iloc[:292]])
    panel = apply_features(Panel(to_spark(spark, pdf)).on_grid(), LITE).on_grid()
    schedule = Schedule(START + pd.Timedelta(hours=5), 250, 12, 12, 10, "expanding")
    for model, options in ((RidgeDMS(1.0), {"lags": 2}), (RidgeSequence(1.0), {"lags": 0, "lookback": 4, "val_ratio": 0.3})):
        monkeypatch.undo()
        done = _run(panel, schedule, model, **options)
        _by_rows(monkeypatch)
        pd.testing.assert_frame_equal(done, _run(panel, schedule, model, **options), rtol=1e-7, atol=1e-12)
        assert done.asset.nunique() == 3 and done[done.asset == "short"].fold_idx.max() < 9


def test_expanding_fits_refuse_holes_and_infinities(panel):
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 12, 8, "expanding")
    gone = Panel(panel.df.filter(F.hour("time") != 7), panel.features, panel.labels).on_grid()
    with pytest.raises(Exception, match="holes or repeated rows"):
        _run(gone, schedule)
    for mode in ("expanding", "sliding"):
        odd = F.when(F.col("time") == F.lit(schedule.at(100)), float("inf")).otherwise(F.col("log_volume"))
        with pytest.raises(Exception, match="missing values or infinities in training rows"):
            _run(Panel(panel.df.withColumn("log_volume", odd), panel.features, panel.labels).on_grid(), Schedule(first, 120, 12, 12, 8, mode))


def test_expanding_tuned_params(spark, panel, monkeypatch):
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 12, 4, "expanding")
    params = spark.createDataFrame([("a", '{"alpha": 50.0}'), ("b", None)], "asset string, params string")
    done = _run(panel, schedule, params=params)
    _by_rows(monkeypatch)
    pd.testing.assert_frame_equal(done, _run(panel, schedule, params=params), rtol=1e-8, atol=1e-12)


def test_expanding_fits_shuffle_in_proportion(spark):
    """Twice the history and twice the folds: twice the rows between stages, not four times."""
    def moved(rows):
        pdf = bar_frame(("a",), rows, 4)
        panel = apply_features(Panel(to_spark(spark, pdf)).on_grid(), LITE).on_grid()
        schedule = Schedule(START + pd.Timedelta(hours=2), 120, 12, 12, (rows - 140) // 12, "expanding")
        plan = walkforward.make_plan(panel, schedule, [RidgeDMS()], horizon=12, lookback=0, scaler=FoldScaler(), val_ratio=0.1, lags=2)
        layout = normal.Layout.of(plan, RidgeDMS())
        spans = panel.df.groupBy("asset").agg(F.min(folds.fold_position(panel, schedule)).alias("_first"), F.max(folds.fold_position(panel, schedule)).alias("_last"))
        halo = normal._halo_rows(panel, schedule, layout, spans, 256).count()
        return halo, normal._fold_table(panel, schedule, layout, spans).count()

    (halo, ends), (halo2, ends2) = moved(1500), moved(3000)
    assert halo2 < 2.2 * halo and ends2 < 2.3 * ends


@pytest.mark.parametrize("mode", ["sliding", "expanding"])
def test_one_decomposition_scores_like_single_fits(panel, mode, monkeypatch):
    first = panel.df.agg(F.min("time")).first()[0]
    schedule = Schedule(first, 120, 12, 12, 8, mode)
    grid = [{"alpha": a} for a in (0.0, 1e-3, 1.0, 30.0, 1e4)]

    def losses():
        out = tuning.score_grid(panel, schedule, RidgeSequence(), grid, horizon=12, lookback=3, val_ratio=0.3)
        return out.toPandas().sort_values(["asset", "trial", "fold_idx"]).reset_index(drop=True)

    done = losses()
    _by_rows(monkeypatch)
    monkeypatch.setattr(fitting, "all_losses", lambda model, candidates, samples: [fitting.fit_one(model.tuned(c), samples) for c in candidates])
    want = losses()
    pd.testing.assert_frame_equal(done, want, rtol=1e-9, atol=1e-12)
    assert len(done) == 2 * 5 * 8 and done.val_loss.notna().all()


def test_moments_merge_and_part():
    rng = np.random.default_rng(2)
    values = rng.normal(size=(60, 4)) + np.array([0, 1e6, -3, 5])
    for diagonal in (False, True):
        parts = [Moments.of(v, diagonal=diagonal) for v in (values[:7], values[7:7], values[7:41], values[41:])]
        total = parts[0].plus(parts[1]).plus(parts[2]).plus(parts[3])
        whole = Moments.of(values, diagonal=diagonal)
        np.testing.assert_allclose(total.mean, whole.mean)
        np.testing.assert_allclose(total.dev, whole.dev, rtol=1e-9, atol=1e-6)
        rest = total.minus(parts[0].plus(parts[2]))
        assert rest.n == 19
        np.testing.assert_allclose(rest.dev, parts[3].dev, rtol=1e-5, atol=1e-4)
        assert total.minus(total).n == 0


def _planted(spark):
    """A label that is an exact linear function of the features of the same row."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"asset": "a", "time": pd.date_range(START, periods=300, freq="h"),
         "log_return_lag_1": rng.normal(size=300), "x2": rng.normal(size=300)}
    )
    pdf["y"] = 2.0 * pdf.log_return_lag_1 - 0.5 * pdf.x2 + 0.25
    return pdf, Panel(to_spark(spark, pdf), ("log_return_lag_1", "x2"), ("y",)).on_grid()


def test_planted_coefficients_are_recovered(spark):
    pdf, panel = _planted(spark)
    out = _run(panel, Schedule(START, 150, 6, 6, 10), RidgeDMS(1e-9), horizon=6, lags=0)
    want = pdf.set_index("time").y
    first = out[out.step == 0]
    np.testing.assert_allclose(first.prediction, want[first.time], atol=1e-8)


def test_ridge_equals_direct_solution(panel, schedule, bars):
    out = _run(panel, schedule, RidgeDMS(2.0), scaler=None)
    g = panel.df.filter("asset = 'a'").toPandas().sort_values("time").reset_index(drop=True)
    r = np.log(g.close / g.close.shift(1))
    x = np.column_stack([g.log_return_1, g.log_volume, r.shift(1), r.shift(2), r.shift(3)])
    ok = ~np.isnan(x).any(axis=1)
    x, y = x[ok], g.log_return.to_numpy()[ok]
    lost = int((~ok).sum())
    a, b = 0, 120 - lost  # fold 0 misses the rows whose lags do not exist
    X = x[a : b - 24]
    Y = np.array([y[i : i + 12] for i in range(a, b - 24)])
    mx, my = X.mean(0), Y.mean(0)
    w = np.linalg.solve((X - mx).T @ (X - mx) + 2 * np.eye(5), (X - mx).T @ (Y - my))
    want = my + (x[b] - mx) @ w
    got = out[(out.asset == "a") & (out.fold_idx == 0)].prediction
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_guards(panel, schedule):
    with pytest.raises(ValueError, match="log_return_lag"):
        walkforward.walk_forward(panel, schedule, RidgeDMS(), horizon=12)
    with pytest.raises(ValueError, match="lookback"):
        walkforward.walk_forward(panel, schedule, RidgeSequence(), horizon=12, lookback=0)
    with pytest.warns(UserWarning, match="differs from horizon"):
        walkforward.walk_forward(panel, schedule, RidgeDMS(), horizon=6, lags=2)
    with pytest.raises(ValueError, match="not features"):
        walkforward.walk_forward(panel, schedule, RidgeDMS(input_columns=("zz",)), horizon=12, lags=2)
    holed = Panel(
        panel.df.withColumn("log_volume", F.when(F.hour("time") != 5, F.col("log_volume"))),
        panel.features, panel.labels,
    ).on_grid()
    with pytest.raises(Exception, match="missing values"):
        walkforward.walk_forward(holed, schedule, RidgeDMS(), horizon=12, lags=2).collect()


def test_two_labels_name_their_predictions(panel, schedule):
    two = panel.add_labels({"double_return": 2 * F.col("log_return")})
    out = walkforward.walk_forward(two, schedule, RidgeSequence(0.1), horizon=12, lookback=6)
    rows = out.select("prediction_log_return", "prediction_double_return").toPandas()
    np.testing.assert_allclose(rows.iloc[:, 1], 2 * rows.iloc[:, 0], rtol=1e-6, atol=1e-9)


class Constant:
    """Estimator with probabilities of as many classes as asked for."""

    def __init__(self, classes=2):
        self.classes = classes

    def fit(self, X, y):
        self.mean = float(np.mean(y))

    def predict(self, X):
        return np.full(len(X), self.mean)

    def predict_proba(self, X):
        return np.tile(np.arange(self.classes) / 10.0, (len(X), 1))


def test_classifier_output_rule():
    X, y = np.zeros((5, 1)), np.arange(5.0)
    for classes, shape in ((2, (5,)), (3, (5, 3))):
        m = EstimatorForecaster(Constant(classes))
        m.fit(X, y)
        assert m.predict(X).shape == shape
    m = EstimatorForecaster(Constant(), classifier=False)
    m.fit(X, np.column_stack([y, y + 1]))
    assert m.predict(X).tolist() == [[2.0, 3.0]] * 5


def test_search(spark, panel, schedule):
    space = {"alpha": ("float", 1e-3, 1e3, {"log": True}), "epochs": ("int", 10, 12)}
    a, b = tuning.sample_space(space, 40, 7), tuning.sample_space(space, 40, 7)
    assert a == b and a != tuning.sample_space(space, 40, 8)
    assert {c["epochs"] for c in a} == {10, 11, 12}
    assert all(1e-3 <= c["alpha"] <= 1e3 for c in a)
    losses = spark.createDataFrame(
        [("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 2.0), ("a", 1, 1, 2.0), ("a", 2, 0, 0.1),
         ("a", 2, 1, None)],
        "asset string, trial long, fold_idx long, val_loss double",
    )
    scores = tuning.trial_scores(losses)  # trial 2 has a fold without a loss
    assert scores.count() == 2
    assert tuning.best_trial(scores).first() == ("a", 0, 2.0)  # a tie goes to trial 0
    assert isinstance(RidgeSequence().tuned({"alpha": 3}), Forecaster)


def test_short_windows_have_no_validation_loss(panel):
    first = panel.df.agg(F.min("time")).first()[0]
    out = walkforward.walk_forward(
        panel, Schedule(first, 50, 12, 12, 3), RidgeSequence(), horizon=12, lookback=10
    )
    assert out.filter("val_active or val_loss is not null").count() == 0


# -- backtest and metrics ------------------------------------------------------------


def _pandas_metrics(r, factor):
    std = r.std()
    equity = (1 + r).cumprod()
    active = r[r != 0]
    return [
        0.0 if r.empty or std == 0 else r.mean() / std * math.sqrt(factor),
        (1 + r).prod() - 1,
        ((equity - equity.cummax()) / equity.cummax()).min(),
        std * math.sqrt(factor),
        0.0 if active.empty else (active > 0).mean(),
    ]


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_metrics_equal_pandas(spark, block_rows):
    rng = np.random.default_rng(2)
    series = {
        "random": pd.Series(rng.normal(0, 0.02, 200)),
        "missing": pd.Series([0.1, None, -0.2, 0.0, 0.3]),
        "flat": pd.Series([0.0] * 5),
        "same": pd.Series([0.01] * 7),
        "single": pd.Series([0.05]),
    }
    rows = [(k, n, None if pd.isna(v) else float(v)) for k, s in series.items() for n, v in enumerate(s)]
    df = spark.createDataFrame(rows, "asset string, i long, r double")
    got = metrics.compute_all(df, ["asset"], "r", "i", annual_factor=252, block_rows=block_rows)
    for row in got.collect():
        want = _pandas_metrics(series[row.asset], 252)
        if row.asset == "same":
            want[0], want[3] = 0.0, 0.0
        mine = [math.nan if v is None else v for v in row[1:]]
        np.testing.assert_allclose(mine, want, rtol=1e-9, atol=1e-12, err_msg=row.asset)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "i long, r double")
    row = metrics.compute_all(empty, [], "r", "i").first()
    assert (row.sharpe_ratio, row.total_return, row.win_rate) == (0.0, 0.0, 0.0)
    assert row.max_drawdown is None and row.volatility is None


def test_total_loss_needs_the_exact_path(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -1.5), ("a", 2, 0.1)], "asset string, i long, r double")
    with pytest.raises(Exception, match="exact=True"):
        metrics.compute_all(df, ["asset"], "r", "i").collect()
    got = metrics.max_drawdown(df, ["asset"], "r", "i", exact=True, block_rows=2).first()[1]
    assert got == pytest.approx(_pandas_metrics(pd.Series([0.5, -1.5, 0.1]), 1)[2])


def test_previous_signal_with_and_without_reach(panel, schedule):
    tests = folds.assign_folds(panel, schedule, ("test",))
    preds = tests.select("asset", "time", (F.col("log_return_1") - 0.001).alias("prediction"))
    one = backtest.backtest(preds, panel, reach=1, block_rows=20)
    two = backtest.backtest(preds, panel, reach=None, block_rows=20)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    first = one.orderBy("asset", "time").first()
    assert first.prev_signal == 0.0


def test_ledger_of_constant_action(spark):
    rows = [("a", f, s, 2, 0.01) for f in range(3) for s in range(4)]
    acts = spark.createDataFrame(rows, "asset string, fold_idx long, step long, action int, actual double")
    carried = ledger.replay_positions(acts, horizon=4, reach=1)
    assert carried.filter("txn_cost < 0").count() == 1
    fresh = ledger.replay_positions(acts, horizon=4, carry_position=False)
    assert fresh.filter("txn_cost < 0").count() == 3
    with pytest.raises(Exception, match="unknown action"):
        ledger.replay_positions(acts.withColumn("action", F.lit(7)), horizon=4, reach=1).collect()


# -- checks ---------------------------------------------------------------------------


def test_enforce_reports_the_first_broken_check(spark):
    none = spark.createDataFrame([], "x long")
    two = spark.createDataFrame([(3,), (1,)], "x long")
    quality.enforce({"a": none})
    with pytest.raises(quality.QualityError, match="b violated 2 time"):
        quality.enforce({"a": none, "b": two, "c": two})


def test_grid_checks(spark):
    pdf = bar_frame(rows=50)
    holed = Panel(to_spark(spark, pdf.drop(index=[20])))
    with pytest.raises(quality.QualityError, match="hourly grid") as e:
        quality.verify_grid(holed)
    assert "19:00" in str(e.value)
    twice = Panel(to_spark(spark, pd.concat([pdf, pdf.iloc[[5]]])))
    with pytest.raises(quality.QualityError):
        quality.verify_grid(twice)
    late = Panel(to_spark(spark, pdf[(pdf.asset == "a") | (pdf.time >= START + pd.Timedelta(days=1))]))
    assert [r.asset for r in quality.assets_agree(late).collect()] == ["b"]
    with pytest.raises(ValueError, match="ceiling"):
        quality.check_lookbacks({"m": 10}, 5)


def test_calendar_needs_enough_rows(panel):
    with pytest.raises(ValueError, match="calendar"):
        calendar_of(panel, Geometry(8760, 24, 24, 168, 24), longest_lookback=720)


def test_edges_of_expanding_folds_are_found_by_many_tasks(spark, monkeypatch):
    """Spans are one row for each series; their folds must not meet in one task, and no series gets another's."""
    monkeypatch.setattr(normal, "TASK_FOLDS", 30, raising=False)
    monkeypatch.setattr(normal, "EDGE_ROWS", 50, raising=False)
    panel = Panel(to_spark(spark, bar_frame(rows=120)), ("close",), ("volume",)).on_grid()
    schedule = Schedule(START, 48, 12, 12, 4, "expanding")
    plan = walkforward.make_plan(
        panel, schedule, [RidgeSequence()], horizon=12, lookback=2, scaler=None, val_ratio=0.3, lags=0
    )
    layout, origin = normal.Layout.of(plan, RidgeSequence()), schedule.origin
    late = F.when(F.col("id") % 2 == 0, 0).otherwise(5)
    spans = spark.range(40).select(
        F.format_string("s%02d", "id").alias("asset"), (F.lit(origin) + late).cast("long").alias("_first"),
        F.lit(origin + 119).cast("long").alias("_last"),
    )
    found = normal._fold_table(panel, schedule, layout, spans)
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 40 * schedule.n_folds * 4 and max(rows) < sum(rows) / 2
    for first, names in ((origin, "s00"), (origin + 5, "s01")):
        w, edges = layout.windows(first, np.arange(schedule.n_folds)), layout.edges(first)
        want = {(k, role, int(c), int(w["n"][k])) for role in normal.ROLES for k, c in enumerate(np.searchsorted(edges, w[role], "left") - 1)}
        got = found.filter(F.col("asset") == names).collect()
        assert {(r.fold_idx, r.role, r.id, r.rows) for r in got} == want and len(got) == len(want)


def test_records_are_summed_where_they_are_made(panel):
    """A block hands on totals up to the end of each stretch that ends in it, and one total for later blocks."""
    first = panel.df.agg(F.min("time")).first()[0]
    schedule, model = Schedule(first, 120, 12, 12, 8, "expanding"), RidgeSequence()
    plan = walkforward.make_plan(panel, schedule, [model], horizon=12, lookback=3, scaler=FoldScaler(), val_ratio=0.2, lags=0)
    layout, origin = normal.Layout.of(plan, model), schedule.origin
    rows = panel.df.filter("asset = 'a'").toPandas().sort_values("time").reset_index(drop=True)
    pdf = rows.assign(_first=origin, **{blocks.POS: origin + np.arange(len(rows))})
    head = [T.StructField("asset", T.StringType()), T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("id", "block")]]
    edges, size = layout.edges(origin), origin + len(rows)

    def ends(found):
        return found[found.kind == "stretch"]

    whole = normal._block_records(layout, "asset", size, T.StructType(head + normal._record_fields()))(("a", 0), pdf)
    assert ends(whole).id.tolist() == list(range(len(edges) - 1)) and (whole.kind != "block").all()
    np.testing.assert_array_equal(ends(whole).row_n.to_numpy(float), edges[1:] - edges[0])
    half = int(edges[3]) + 1  # in a stretch
    parts = normal._block_records(layout, "asset", half, T.StructType(head + normal._record_fields()))(("a", 0), pdf)
    assert ends(parts).id.tolist() == [0, 1, 2]
    assert parts[parts.kind == "block"].row_n.tolist() == [half - edges[0]]


def test_folds_of_one_block_are_solved_in_it(panel, monkeypatch):
    """Such folds hand on their results alone: no stretch leaves the block, and no edge is looked up."""
    first = panel.df.agg(F.min("time")).first()[0]
    schedule, grid = Schedule(first, 120, 12, 12, 8, "expanding"), [{"alpha": 1.0}, {"alpha": 50.0}]

    def losses():
        out = tuning.score_grid(panel, schedule, RidgeSequence(), grid, horizon=12, lookback=3, val_ratio=0.3)
        return out.toPandas().sort_values(["asset", "trial", "fold_idx"]).reset_index(drop=True)

    def none(*_):
        raise AssertionError("edges of folds were looked up")

    monkeypatch.setattr(normal, "STRETCHES", 5)  # blocks of 15 rows, whose folds go over several
    spread = losses()
    monkeypatch.undo()
    monkeypatch.setattr(normal, "STRETCHES", 10**9)
    monkeypatch.setitem(normal.solve_folds.__kwdefaults__, "block_rows", 10**7)  # all hours are below
    monkeypatch.setattr(normal, "_fold_table", none)
    whole = losses()
    assert len(whole) == 2 * 2 * 8
    pd.testing.assert_frame_equal(whole, spread, rtol=1e-9, atol=1e-12)


def test_totals_of_stretches_equal_merged_records():
    """Also where levels are far apart, and where the last stretches have no samples."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(60, 3)) + np.where(np.arange(60) < 25, 0, 1e6)[:, None]
    samples, fine, cuts = rows[:41, :2], np.arange(60) % 7 > 0, np.array([4, 10, 25, 26, 40, 50, 60])
    got, want = normal._totals(samples, rows, fine, cuts), None
    for a, b, total in zip(cuts[:-1], cuts[1:], got, strict=True):
        part = normal.Record(
            Moments.of(samples[a : min(b, 41)]), Moments.of(rows[a:b], diagonal=True),
            rows[a:b].min(axis=0), rows[a:b].max(axis=0), float((~fine[a:b]).sum()),
        )
        want = part if want is None else want.plus(part)
        for name, value in want.packed().items():
            np.testing.assert_allclose(total.packed()[name], value, rtol=1e-12, atol=1e-12)
    empty = normal._totals(rows[:3, :2], rows, fine, np.array([4, 10]))[0]
    assert empty.joint.n == 0 and empty.joint.dev.shape == (2, 2)


def test_blocks_are_whole_however_rows_arrive():
    """Tables of rows end anywhere; a block is handed on once and whole, and no longer than need be kept."""
    names = ["a"] * 5 + ["b"] * 1 + ["c"] * 6
    pdf = pd.DataFrame({"asset": names, blocks.BLOCK: [0] * 2 + [1] * 3 + [1] + [1] * 6, blocks.POS: range(12)})
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "rows")])

    def rows(key, part):
        assert (part.asset == key[0]).all() and (part[blocks.BLOCK] == key[1]).all()
        return [{"first": int(part[blocks.POS].iloc[0]), "rows": len(part)}]

    for size in (1, 4, 5, 12):
        frames = (pdf.iloc[a : a + size] for a in range(0, 12, size))
        found = list(normal._each_block("asset", rows, schema, 2)(frames))
        assert pd.concat(found).values.tolist() == [[0, 2], [2, 3], [5, 1], [6, 6]] and len(found) == 2
    assert list(normal._each_block("asset", rows, schema, 2)(iter([]))) == []
