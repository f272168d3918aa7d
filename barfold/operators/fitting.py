"""What one task does with the rows of a few neighbouring folds: NumPy only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from barfold.operators.models import SEQUENCE, TABULAR, Forecaster, RidgeDMS, RidgeSequence
from barfold.operators.moments import ridge_losses
from barfold.operators.samples import inner_split_size


@dataclass(frozen=True)
class FoldPlan:
    """Settings of a walk-forward run, shipped to the tasks."""

    features: tuple[str, ...]
    labels: tuple[str, ...]
    horizon: int
    lookback: int
    val_ratio: float
    method: str | None
    scaled: tuple[str, ...]
    scale_labels: bool
    origin: int
    train: int
    test: int
    step: int
    n_folds: int
    expanding: bool
    lags: int = 0
    lag_price: str | None = None

    def edges(self, fold: int) -> tuple[int, int, int]:
        end = self.origin + fold * self.step + self.train
        return (self.origin if self.expanding else end - self.train), end, end + self.test


@dataclass
class Fold:
    """One fold, scaled: ``x``/``y`` untrimmed training rows, ``kept`` of them usable."""

    index: int
    x: np.ndarray
    y: np.ndarray
    kept: int
    x_test: np.ndarray
    test_pos: np.ndarray
    last_pos: int
    label_center: np.ndarray
    label_scale: np.ndarray


def center_and_scale(method: str, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if method == "standard":
        center, scale = values.mean(axis=0), values.std(axis=0)
        scale[values.min(axis=0) == values.max(axis=0)] = 0.0
    elif method == "minmax":
        center = values.min(axis=0)
        scale = values.max(axis=0) - center
    else:
        low, center, high = np.percentile(values, [25, 50, 75], axis=0)
        scale = high - low
    return center, np.where(scale == 0, 1.0, scale)


def with_lags(x: np.ndarray, price: np.ndarray, lags: int) -> np.ndarray:
    """``x`` and its lagged one-step log returns, nearest first; NaN where not all exist."""
    wide = np.full((len(price), lags), np.nan)
    if len(price) > lags + 1:
        r = np.log(price[1:] / price[:-1])
        wide[lags + 1 :] = sliding_window_view(r, lags)[:-1, ::-1]
    return np.hstack([x, wide])


def iter_folds(plan: FoldPlan, chunk: range, pdf) -> Iterator[Fold]:
    pdf = pdf.sort_values("_pos", kind="stable")
    pos = pdf["_pos"].to_numpy()
    x = pdf[list(plan.features)].to_numpy(dtype=float)
    y = pdf[list(plan.labels)].to_numpy(dtype=float)
    names = list(plan.features)
    if plan.lags:
        x = with_lags(x, pdf[plan.lag_price].to_numpy(dtype=float), plan.lags)
        names += [f"log_return_lag_{k}" for k in range(1, plan.lags + 1)]
        whole = ~np.isnan(x[:, len(plan.features) :]).any(axis=1)
        pos, x, y = pos[whole], x[whole], y[whole]
    chosen = [n in plan.scaled for n in names] if plan.scaled else [True] * len(names)
    chosen = np.array(chosen, dtype=bool)

    for fold in chunk:
        a, b, c = np.searchsorted(pos, plan.edges(fold))
        if a == b or b == c:
            continue
        kept = b - a - plan.horizon if b - a > plan.horizon else b - a
        fx, fy, tx = x[a:b].copy(), y[a:b].copy(), x[b:c].copy()
        if not (np.isfinite(fx[:kept]).all() and np.isfinite(fy[:kept]).all()):
            raise ValueError(f"fold {fold}: missing values or infinities in training rows")
        center, scale = np.zeros(fy.shape[1]), np.ones(fy.shape[1])
        if plan.method:
            mid, spread = center_and_scale(plan.method, fx[:kept])
            mid, spread = np.where(chosen, mid, 0.0), np.where(chosen, spread, 1.0)
            fx, tx = (fx - mid) / spread, (tx - mid) / spread
            if plan.scale_labels:
                center, scale = center_and_scale(plan.method, fy[:kept])
                fy = (fy - center) / scale
        yield Fold(fold, fx, fy, kept, tx, pos[b:c], int(pos[a + kept - 1]), center, scale)


def window_samples(
    x: np.ndarray, y: np.ndarray, lookback: int, horizon: int
) -> tuple[np.ndarray, np.ndarray]:
    """All stride-1 samples of rows in order."""
    n = len(x) - lookback - horizon + 1
    if n < 1:
        raise ValueError(
            f"{len(x)} rows, but lookback {lookback} and horizon {horizon} need"
            f" {lookback + horizon}"
        )
    past = sliding_window_view(x, lookback, axis=0)[:n].swapaxes(1, 2)
    ahead = sliding_window_view(y, horizon, axis=0)[lookback : lookback + n].swapaxes(1, 2)
    return past, ahead


@dataclass
class Samples:
    """Training samples of a fold, its validation samples if any, and the input to predict."""

    x: np.ndarray
    y: np.ndarray
    val: tuple[np.ndarray, np.ndarray] | None
    context: np.ndarray


def fold_samples(plan: FoldPlan, fold: Fold, data_format: str, columns: Sequence[int] | None) -> Samples:
    pick = slice(None) if columns is None else list(columns)
    x, y, n = fold.x[: fold.kept, pick], fold.y[: fold.kept], fold.kept
    if data_format == TABULAR:
        valid = n - plan.horizon
        if valid < 1:
            raise ValueError(f"fold {fold.index}: {n} rows are too few for horizon {plan.horizon}")
        target = sliding_window_view(y[:, 0], plan.horizon)[:valid]
        context = fold.x_test[:1, pick]
        if not np.isfinite(context).all():
            raise ValueError(f"fold {fold.index}: missing values or infinities in test features")
        return Samples(x[:valid], target, None, context)
    if data_format != SEQUENCE:
        raise ValueError(f"unknown data format {data_format!r}")
    context = fold.x[-plan.lookback :, pick][None]
    if not np.isfinite(context).all():
        raise ValueError(f"fold {fold.index}: missing values or infinities in the last inputs")
    size = inner_split_size(n, plan.lookback, plan.horizon, plan.val_ratio)
    if size is None:
        return Samples(*window_samples(x, y, plan.lookback, plan.horizon), None, context)
    cut = n - size
    train = window_samples(x[:cut], y[:cut], plan.lookback, plan.horizon)
    val = window_samples(x[cut:], y[cut:], plan.lookback, plan.horizon)
    return Samples(*train, val, context)


def input_positions(plan: FoldPlan, model: Forecaster) -> list[int] | None:
    if not model.input_columns:
        return None
    names = [*plan.features, *[f"log_return_lag_{k}" for k in range(1, plan.lags + 1)]]
    return [names.index(c) for c in model.input_columns]


def fit_one(model: Forecaster, samples: Samples) -> float | None:
    """Fit, and return the loss on the validation samples where there are any."""
    model.fit(samples.x, samples.y)
    if samples.val is None:
        return None
    error = np.asarray(model.predict(samples.val[0])) - samples.val[1]
    return float(np.mean(error * error))


def all_losses(model: Forecaster, candidates: Sequence[dict], samples: Samples) -> list[float | None]:
    """The loss of every candidate. Ridge models share one decomposition of the fold's
    samples; other models are fitted one by one."""
    tuned = [model.tuned(c) for c in candidates]
    ridge = all(type(m) in (RidgeDMS, RidgeSequence) and m.input_columns == model.input_columns for m in tuned)
    if not ridge or samples.val is None:
        return [fit_one(m, samples) for m in tuned]
    flat = [a.reshape(len(a), -1) for a in (samples.x, samples.y, *samples.val)]
    return ridge_losses(*flat, [m.alpha for m in tuned])


def forecast(plan: FoldPlan, fold: Fold, model: Forecaster, samples: Samples) -> np.ndarray:
    """The fold's forecast, ``(horizon, labels)``, in label units."""
    raw = np.asarray(model.predict(samples.context), dtype=float)
    steps = raw.reshape(-1, 1) if model.data_format == TABULAR else raw[0]
    if not plan.scale_labels or not plan.method:
        return steps
    return steps * fold.label_scale + fold.label_center
