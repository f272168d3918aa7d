"""Walk-forward fitting and forecasting of every fold of every asset in one job.

Rows are grouped by ``(asset, chunk of folds)``. A chunk of ``k`` folds needs
``train + k*step`` rows, so a row travels to few chunks instead of to every
fold that trains on it, and a group has a size known in advance however long
the series is. Expanding ridge fits over gap-free series add up normal equations
instead (``normal``), as a fold's training set is all rows before it; expanding
fits of other models ship these rows.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.operators import blocks, fitting, normal
from barfold.operators.calendar import Schedule
from barfold.operators.fitting import FoldPlan
from barfold.operators.folds import fold_position
from barfold.operators.models import SEQUENCE, TABULAR, Forecaster
from barfold.operators.scaling import FoldScaler
from barfold.panel import Panel

FOLDS_PER_TASK = 64


def make_plan(
    panel: Panel,
    schedule: Schedule,
    models: Sequence[Forecaster],
    *,
    horizon: int,
    lookback: int,
    scaler: FoldScaler | None,
    val_ratio: float,
    lags: int,
) -> FoldPlan:
    """Check the settings against each other and freeze them."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    formats = {m.data_format for m in models}
    if SEQUENCE in formats and lookback <= 0:
        raise ValueError("sequence models need a positive lookback")
    unknown = formats - {TABULAR, SEQUENCE}
    if unknown:
        raise ValueError(f"unknown data format {sorted(unknown)}")
    features, labels = panel.feature_cols, panel.label_cols
    has_lags = lags > 0 or any(c.startswith("log_return_lag_") for c in features)
    if TABULAR in formats and not has_lags:
        raise ValueError(
            "tabular models take their past from log_return_lag_* features; add them"
            " with add_lagged_returns or pass lags="
        )
    if not labels:
        raise ValueError("the panel has no label column")
    if TABULAR in formats and len(labels) > 1:
        raise ValueError("tabular models forecast one label")
    if schedule.test != horizon:
        warnings.warn(
            f"test window of {schedule.test} steps differs from horizon {horizon};"
            " each fold predicts one horizon",
            UserWarning,
            stacklevel=3,
        )
    known = {*features, *[f"log_return_lag_{k}" for k in range(1, lags + 1)]}
    for model in models:
        missing = [c for c in model.input_columns if c not in known]
        if missing:
            raise ValueError(f"input columns {missing} are not features")
    return FoldPlan(
        features=tuple(features),
        labels=tuple(labels),
        horizon=horizon,
        lookback=lookback,
        val_ratio=val_ratio,
        method=scaler.method if scaler else None,
        scaled=tuple(scaler.columns or ()) if scaler else (),
        scale_labels=bool(scaler and scaler.scale_labels),
        origin=schedule.origin,
        train=schedule.train,
        test=schedule.test,
        step=schedule.step,
        n_folds=schedule.n_folds,
        expanding=schedule.mode == "expanding",
        lags=lags,
        lag_price=panel.ohlcv["close"] if lags else None,
    )


def fold_chunks(
    panel: Panel, schedule: Schedule, columns: Sequence[str], folds_per_task: int, extra: int
) -> DataFrame:
    """Slim rows with ``_chunk``; a row is copied to each chunk that uses it."""
    n_chunks = -(-schedule.n_folds // folds_per_task)
    span = folds_per_task * schedule.step
    reach = schedule.train + schedule.test
    slim = panel.df.select(
        panel.asset, fold_position(panel, schedule).alias(blocks.POS), *dict.fromkeys(columns)
    )
    off = F.col(blocks.POS) - F.lit(schedule.origin)
    used = (off >= -extra) & (off < (schedule.n_folds - 1) * schedule.step + reach)
    low = F.greatest(F.lit(0), blocks.floor_div(off - reach + schedule.step, span))
    high = (
        F.lit(n_chunks - 1)
        if schedule.mode == "expanding"
        else F.least(F.lit(n_chunks - 1), blocks.floor_div(off + extra, span))
    )
    return blocks.explode_range(slim.filter(used), "_chunk", low, high)


def chunk_range(plan_folds: int, folds_per_task: int, chunk: int) -> range:
    return range(chunk * folds_per_task, min((chunk + 1) * folds_per_task, plan_folds))


def prediction_columns(labels: Sequence[str]) -> list[str]:
    return ["prediction"] if len(labels) == 1 else [f"prediction_{c}" for c in labels]


def walk_forward(
    panel: Panel,
    schedule: Schedule,
    model: Forecaster,
    *,
    horizon: int,
    lookback: int = 336,
    scaler: FoldScaler | None = FoldScaler(),
    val_ratio: float = 0.1,
    lags: int = 0,
    folds_per_task: int = FOLDS_PER_TASK,
    params: DataFrame | None = None,
) -> DataFrame:
    """Per fold: trim, reset, scale, fit, predict, scale back.

    One row per ``(asset, fold_idx, step)`` with the predicted row's ``time``,
    ``prediction`` (or ``prediction_<label>``), and the fold's ``val_loss``,
    ``val_active`` and ``last_train_label_ts``. ``lags`` builds that many lagged
    return features inside the task, so they are never shuffled. ``params`` has
    model parameters per asset as JSON (``asset, params``). Series are
    expected on the grid of the schedule (see ``quality.verify_grid``); folds
    without training or test rows are left out.
    """
    plan = make_plan(
        panel, schedule, [model], horizon=horizon, lookback=lookback, scaler=scaler,
        val_ratio=val_ratio, lags=lags,
    )
    columns = [*plan.features, *plan.labels, *([plan.lag_price] if lags else [])]
    outs = prediction_columns(plan.labels)
    result = T.StructType(
        [
            T.StructField(panel.asset, panel.df.schema[panel.asset].dataType),
            T.StructField("fold_idx", T.LongType()),
            T.StructField("step", T.LongType()),
            T.StructField("_pos", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in outs],
            T.StructField("val_loss", T.DoubleType()),
            T.StructField("val_active", T.BooleanType()),
            T.StructField("_last", T.LongType()),
        ]
    )
    asset, tuned = panel.asset, params is not None
    if normal.applies(plan, panel, model):
        raw = normal.solve_folds(
            panel, schedule, plan, model, normal.forecast_rows(plan, model, asset, outs), result, params=params
        )
        return _told(raw, panel, schedule, outs)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = []
        picked = fitting.input_positions(plan, model)
        chosen = json.loads(pdf["_params"].iloc[0] or "{}") if tuned else {}
        for fold in fitting.iter_folds(
            plan, chunk_range(plan.n_folds, folds_per_task, int(key[1])), pdf
        ):
            fresh = model.tuned(chosen)
            samples = fitting.fold_samples(plan, fold, model.data_format, picked)
            loss = fitting.fit_one(fresh, samples)
            values = fitting.forecast(plan, fold, fresh, samples)
            at = fold.test_pos[: plan.horizon]
            if values.shape != (len(at), len(outs)):
                raise ValueError(
                    f"{key[0]} fold {fold.index}: forecast of shape {values.shape} for"
                    f" {len(at)} test rows"
                )
            done.append(
                pd.DataFrame(
                    {
                        asset: key[0],
                        "fold_idx": fold.index,
                        "step": np.arange(len(at)),
                        "_pos": at,
                        **{c: values[:, n] for n, c in enumerate(outs)},
                        "val_loss": np.nan if loss is None else loss,
                        "val_active": loss is not None,
                        "_last": fold.last_pos,
                    }
                )
            )
        if not done:
            return pd.DataFrame({f.name: [] for f in result.fields})
        return pd.concat(done, ignore_index=True)

    chunks = fold_chunks(panel, schedule, columns, folds_per_task, lags + 1 if lags else 0)
    if tuned:
        chunks = chunks.join(params.select(asset, F.col("params").alias("_params")), asset, "left")
    return _told(chunks.groupBy(asset, "_chunk").applyInPandas(run, result), panel, schedule, outs)


def _told(raw: DataFrame, panel: Panel, schedule: Schedule, outs: Sequence[str]) -> DataFrame:
    return raw.select(
        panel.asset,
        "fold_idx",
        "step",
        blocks.grid_time("_pos", schedule.seconds).alias(panel.time),
        *outs,
        F.nanvl("val_loss", F.lit(None).cast("double")).alias("val_loss"),
        "val_active",
        blocks.grid_time("_last", schedule.seconds).alias("last_train_label_ts"),
    )
