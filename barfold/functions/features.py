"""Feature and label transforms, and the engine that runs a list of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.functions import smoothing
from barfold.functions.smoothing import SeriesFrame
from barfold.operators import blocks
from barfold.panel import Panel

# The shared feature set and its label. The order is part of the
# feature tag.
DEFAULT_FEATURES = [
    {"name": "LOG_RETURN_1"},
    {"name": "VOL_SCALED_RETURN", "span": 72},
    {"name": "EWM_VOLATILITY", "span": 72},
    {"name": "RSI", "period": 14},
    {"name": "MACD_NORM", "fast": 12, "slow": 26, "norm_period": 72},
    {"name": "LOG_VOLUME"},
]
DEFAULT_LABEL = {"name": "log_return", "horizon": 1}
DEFAULT_CONFIG = [*DEFAULT_FEATURES, DEFAULT_LABEL]

Reach = int | Callable[..., int]


@dataclass(frozen=True)
class Transform:
    """A named builder of columns.

    ``build(frame, **params)`` returns output columns by name. ``before`` and
    ``after`` say how many rows it looks back and ahead.
    """

    name: str
    role: str
    build: Callable[..., Mapping[str, Column]]
    before: Reach
    after: Reach

    def reach(self, params: Mapping) -> tuple[int, int]:
        def size(r: Reach) -> int:
            return r(**params) if callable(r) else r

        return size(self.before), size(self.after)


_TRANSFORMS: dict[str, Transform] = {}


def register(name: str, *, role: str = "feature", before: Reach = 0, after: Reach = 0):
    """Decorator that makes a builder available under ``name`` (any case)."""
    if role not in ("feature", "label"):
        raise ValueError(f"role must be 'feature' or 'label', got {role!r}")

    def add(build):
        _TRANSFORMS[name.upper()] = Transform(name.upper(), role, build, before, after)
        return build

    return add


def available_transforms() -> list[str]:
    return sorted(_TRANSFORMS)


def feature_tag(config: Sequence[Mapping]) -> str:
    """Short hash of the configuration, equal for equal configurations."""
    text = json.dumps([dict(c) for c in config], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


# -- transforms --------------------------------------------------------------


def _ewm_reach(span: int = 72, **_) -> int:
    return smoothing.memory_rows(smoothing.span_decay(span)) + span + 2


@register("LOG_RETURN_1", before=1)
def _log_return_1(frame: SeriesFrame, column: str = "close", **_):
    return {"log_return_1": F.col(frame.log_return(column))}


def _ewm_vol(frame: SeriesFrame, column: str, span: int) -> Column:
    return frame.ewm_std(f"_vol_{column}_{span}", frame.log_return(column), span)


@register("EWM_VOLATILITY", before=_ewm_reach)
def _ewm_volatility(frame: SeriesFrame, column: str = "close", span: int = 72, **_):
    return {"ewm_volatility": _ewm_vol(frame, column, span)}


@register("VOL_SCALED_RETURN", before=_ewm_reach)
def _vol_scaled_return(
    frame: SeriesFrame, column: str = "close", span: int = 72, eps: float = 1e-8, **_
):
    vol = _ewm_vol(frame, column, span)
    return {"vol_scaled_return": F.try_divide(F.col(frame.log_return(column)), vol + F.lit(eps))}


def _rsi_reach(period: int = 14, **_) -> int:
    return smoothing.memory_rows(smoothing.wilder_decay(period)) + period + 2


@register("RSI", before=_rsi_reach)
def _rsi(frame: SeriesFrame, period: int = 14, **_):
    column = frame.ohlcv["close"]
    move = F.col(column) - frame.lag(column)
    frame.let("_gain", F.greatest(move, F.lit(0.0)), f"_{column}_lag_1")
    frame.let("_loss", F.greatest(-move, F.lit(0.0)), f"_{column}_lag_1")
    up = frame.wilder_mean(f"_up_{period}", "_gain", period)
    down = frame.wilder_mean(f"_down_{period}", "_loss", period)
    total = up + down
    # A series that never moved has RSI 0.
    return {
        "rsi": F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(100 * up, total))
    }


def _macd_reach(fast: int = 12, slow: int = 26, norm_period: int = 72, **_) -> int:
    decays = [smoothing.span_decay(s) for s in (fast, slow)]
    return max(norm_period, *[smoothing.memory_rows(d) for d in decays]) + 2


@register("MACD_NORM", before=_macd_reach)
def _macd_norm(
    frame: SeriesFrame,
    column: str = "close",
    fast: int = 12,
    slow: int = 26,
    norm_period: int = 72,
    eps: float = 1e-8,
    **_,
):
    quick = frame.ewm_mean(f"_ema_{column}_{fast}", column, smoothing.span_decay(fast))
    late = frame.ewm_mean(f"_ema_{column}_{slow}", column, smoothing.span_decay(slow))
    spread = frame.rolling_std(
        f"_std_{column}_{norm_period}", column, norm_period, f"_ema_{column}_{fast}_sum"
    )
    return {"macd_norm": F.try_divide(quick - late, spread + F.lit(eps))}


@register("LOG_VOLUME")
def _log_volume(frame: SeriesFrame, column: str = "volume", **_):
    v = F.col(column)
    return {"log_volume": F.when(v > 0, F.ln(v))}


def _label_reach(horizon: int = 1, **_) -> int:
    return horizon


@register("LOG_RETURN", role="label", after=_label_reach)
def _log_return(frame: SeriesFrame, column: str = "close", horizon: int = 1, **_):
    now, ahead = F.col(column), frame.lag(column, -horizon)
    return {"log_return": F.when((now > 0) & (ahead > 0), F.ln(ahead / now))}


@register(
    "SIMPLE_RETURN",
    role="label",
    before=lambda shift=-1, **_: max(shift, 0) + 1,
    after=lambda shift=-1, **_: max(-shift, 0) + 1,
)
def _simple_return(frame: SeriesFrame, column: str = "close", shift: int = -1, **_):
    here, before = frame.lag(column, shift), frame.lag(column, shift + 1)
    return {"simple_return": F.try_divide(here, before) - 1}


@register("LAGGED_RETURNS", before=lambda lags=336, **_: lags + 1)
def _lagged_returns(frame: SeriesFrame, column: str = "close", lags: int = 336, **_):
    r = frame.log_return(column)
    return {f"log_return_lag_{k}": frame.lag(r, k) for k in range(1, lags + 1)}


# -- engine ------------------------------------------------------------------


def apply_features(
    panel: Panel,
    config: Sequence[Mapping] = DEFAULT_CONFIG,
    *,
    drop_incomplete: bool = True,
    block_rows: int = blocks.BLOCK_ROWS,
) -> Panel:
    """Run the configured transforms in order, then drop incomplete rows once.

    One shuffle by ``(asset, block)`` serves all transforms. On a grid, a later
    ``slice_time`` reads the source no farther than the transforms reach.
    """
    todo = []
    for spec in config:
        params = {k: v for k, v in spec.items() if k != "name"}
        found = _TRANSFORMS.get(spec["name"].upper())
        if found is None:
            raise KeyError(
                f"unknown transform {spec['name']!r}; known: {available_transforms()}"
            )
        todo.append((found, params))

    reaches = [t.reach(p) for t, p in todo]
    before = max([b for b, _ in reaches], default=0)
    after = max([a for _, a in reaches], default=0)
    block_rows = max(block_rows, before, after)

    cut = blocks.with_halo(
        panel.with_positions(), before=before, after=after, block_rows=block_rows
    ).repartition(panel.asset, blocks.BLOCK)
    frame = SeriesFrame(cut, panel.asset, panel.time, panel.ohlcv)
    features, labels = list(panel.features), list(panel.labels)
    outputs: dict[str, Column] = {}
    for transform, params in todo:
        made = transform.build(frame, **params)
        outputs.update(made)
        (features if transform.role == "feature" else labels).extend(made)
    df = frame.finish(outputs).drop(blocks.POS)
    out = replace(
        panel,
        df=df.select(*[c for c in panel.df.columns if c not in outputs], *outputs),
        features=tuple(dict.fromkeys(features)),
        labels=tuple(dict.fromkeys(labels)),
    )
    out = out.drop_incomplete(fence=True) if drop_incomplete else out
    if not panel.grid_seconds:
        return out

    def narrowed(start: datetime, end: datetime) -> DataFrame:
        step = timedelta(seconds=panel.grid_seconds)
        part = panel.clip_inclusive(start - before * step, end + after * step)
        made = apply_features(part, config, drop_incomplete=drop_incomplete, block_rows=block_rows)
        return made.df

    return replace(out, narrowed=(out.df, narrowed))


def add_lagged_returns(
    panel: Panel, lags: int, column: str = "close", *, block_rows: int = blocks.BLOCK_ROWS
) -> Panel:
    """The explicit lag step for tabular models: lag columns, then complete rows."""
    return apply_features(
        panel,
        [{"name": "LAGGED_RETURNS", "lags": lags, "column": column}],
        block_rows=block_rows,
    )


def lagged_return_array(
    panel: Panel,
    lags: int,
    column: str = "close",
    *,
    out: str = "log_return_lags",
    block_rows: int = blocks.BLOCK_ROWS,
) -> Panel:
    """The same lags as one array column, nearest first; NULL where not all exist."""
    cut = blocks.with_halo(
        panel.with_positions(), before=lags + 1, block_rows=max(block_rows, lags + 1)
    ).repartition(panel.asset, blocks.BLOCK)
    frame = SeriesFrame(cut, panel.asset, panel.time, panel.ohlcv)
    r = frame.log_return(column)
    seen = F.collect_list(r).over(frame.rows.rowsBetween(-lags, -1))
    frame.let("_lags", seen, "_stride", r, windows=1)
    full = F.when(F.size("_lags") == lags, F.reverse("_lags"))
    df = frame.finish({out: full}).drop(blocks.POS)
    return replace(panel, df=df, features=tuple(dict.fromkeys([*panel.features, out])))
