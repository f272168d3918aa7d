"""Search over model parameters, scored on the inner validation blocks of all folds."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.operators import blocks, fitting, normal
from barfold.operators.calendar import Schedule
from barfold.operators.models import Forecaster
from barfold.operators.scaling import FoldScaler
from barfold.operators.walkforward import FOLDS_PER_TASK, chunk_range, fold_chunks, make_plan
from barfold.panel import Panel


def sample_space(space: Mapping[str, Sequence], n_trials: int, seed: int) -> list[dict]:
    """Random candidates from ``{name: ("float"|"int", low, high[, {"log": True}])}``.

    Integer ranges include both ends. Equal arguments give equal candidates.
    """
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_trials):
        params = {}
        for name, (kind, low, high, *rest) in space.items():
            log = bool(rest and rest[0].get("log"))
            if kind not in ("float", "int"):
                raise ValueError(f"unknown parameter type {kind!r} of {name}")
            if low > high or (log and low <= 0):
                raise ValueError(f"bad range [{low}, {high}] of {name}")
            edge = 0.5 if kind == "int" else 0.0
            a, b = low - edge, high + edge
            if log:
                value = math.exp(rng.uniform(math.log(max(a, low / 2)), math.log(b)))
            else:
                value = rng.uniform(a, b)
            value = min(max(value, low), high)
            params[name] = int(round(value)) if kind == "int" else value
        out.append(params)
    return out


def score_grid(
    panel: Panel,
    schedule: Schedule,
    model: Forecaster,
    candidates: Sequence[Mapping],
    *,
    horizon: int,
    lookback: int = 336,
    scaler: FoldScaler | None = FoldScaler(),
    val_ratio: float = 0.1,
    lags: int = 0,
    folds_per_task: int = FOLDS_PER_TASK,
) -> DataFrame:
    """Validation loss of every candidate on every fold: ``asset, trial, fold_idx, val_loss``.

    Candidates are tried inside the task that holds the fold, so rows are
    shuffled and scaled once for all of them; ridge candidates share one
    decomposition. Expanding ridge searches read no row twice (``normal``).
    Values of test windows are never read.
    """
    plan = make_plan(
        panel, schedule, [model], horizon=horizon, lookback=lookback, scaler=scaler,
        val_ratio=val_ratio, lags=lags,
    )
    tried = [dict(c) for c in candidates]
    columns = [*plan.features, *plan.labels, *([plan.lag_price] if lags else [])]
    result = T.StructType(
        [
            T.StructField(panel.asset, panel.df.schema[panel.asset].dataType),
            T.StructField("trial", T.LongType()),
            T.StructField("fold_idx", T.LongType()),
            T.StructField("val_loss", T.DoubleType()),
        ]
    )

    if normal.applies(plan, panel, model) and all(normal.same_inputs(model, c) for c in tried):
        raw = normal.solve_folds(
            panel, schedule, plan, model, normal.loss_rows(model, panel.asset, tried), result
        )
        return raw.withColumn("val_loss", F.nanvl("val_loss", F.lit(None).cast("double")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        picked = fitting.input_positions(plan, model)
        for fold in fitting.iter_folds(
            plan, chunk_range(plan.n_folds, folds_per_task, int(key[1])), pdf
        ):
            samples = fitting.fold_samples(plan, fold, model.data_format, picked)
            losses = fitting.all_losses(model, tried, samples)
            rows += [(key[0], trial, fold.index, loss) for trial, loss in enumerate(losses)]
        return pd.DataFrame(rows, columns=result.fieldNames())

    chunks = fold_chunks(panel, schedule, columns, folds_per_task, lags + 1 if lags else 0)
    raw = chunks.groupBy(panel.asset, "_chunk").applyInPandas(run, result)
    return raw.withColumn("val_loss", F.nanvl("val_loss", F.lit(None).cast("double")))


def running_score(
    losses: DataFrame, keys: Sequence[str] = ("asset", "trial"), **options
) -> DataFrame:
    """Mean loss of a trial over the folds up to and including each fold."""
    done = blocks.running(
        losses,
        keys,
        {"_sum": ("sum", "val_loss"), "_n": ("sum", F.when(F.col("val_loss").isNotNull(), 1.0))},
        position="fold_idx",
        **options,
    )
    return done.withColumn("running_score", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def trial_scores(losses: DataFrame, keys: Sequence[str] = ("asset", "trial")) -> DataFrame:
    """Mean loss per trial; a trial with a fold that had no validation loss is discarded."""
    return (
        losses.groupBy(*keys)
        .agg(
            F.avg("val_loss").alias("score"),
            F.count(F.lit(1)).alias("n_folds"),
            F.count_if(F.col("val_loss").isNull()).alias("_missing"),
        )
        .filter(F.col("_missing") == 0)
        .drop("_missing")
    )


def best_trial(
    scores: DataFrame, keys: Sequence[str] = ("asset",), *, direction: str = "minimize"
) -> DataFrame:
    """The best trial and its score; ties go to the lower trial number."""
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"direction must be 'minimize' or 'maximize', got {direction!r}")
    value = F.col("score") if direction == "minimize" else -F.col("score")
    rank = F.struct(value, F.col("trial"))
    return scores.groupBy(*keys).agg(
        F.min_by("trial", rank).alias("best_trial"), F.min_by("score", rank).alias("best_value")
    )


def trial_table(scores: DataFrame, candidates: Sequence[Mapping]) -> DataFrame:
    """Scores with the parameters of each trial as JSON."""
    texts = F.array(*[F.lit(json.dumps(dict(c), sort_keys=True)) for c in candidates])
    return scores.withColumn("params", F.get(texts, F.col("trial").cast("int")))
