"""Forecasts of all assets for a set of models, into the store."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.operators import backtest, ledger, tuning, walkforward
from barfold.operators.models import TABULAR
from barfold.plans.context import ModelSpec, RunContext
from barfold.sources.store import ForecastStore, Run

# Half of the store, and the schedule of the calendar that fills it.
PASSES = {"in_sample": "in_sample_dense", "oos": "oos"}


def produce_forecasts(
    spark: SparkSession,
    ctx: RunContext,
    store: ForecastStore,
    models: Sequence[str] | None = None,
    *,
    seed: int = 0,
    folds_per_task: int = walkforward.FOLDS_PER_TASK,
) -> list[Run]:
    """Tune, forecast the dense in-sample and the out-of-sample schedule, store, check.

    Every step is one job over all assets of a model. On an error the runs are
    marked failed and keep what they stored; running again replaces it.
    """
    names = list(models or ctx.models)
    store.write_config_once(ctx.payloads())
    runs = [(asset, name, seed) for name in names for asset in ctx.assets]
    started = store.begin(runs)
    try:
        staged, meta = [], []
        for name in names:
            best = search(ctx, store, name, seed, folds_per_task)
            meta.append(_meta(ctx, name, seed, best))
            for split in PASSES:
                rows = _pass(ctx, name, seed, split, best, folds_per_task)
                staged.append(store.write_staged(rows, f"{name}-{seed}-{split}"))
        rows = reduce(DataFrame.unionByName, staged)
        edges = boundaries(spark, ctx)
        store.write_forecasts(rows, boundaries=edges, horizon=ctx.horizon)
        store.write_folds(_folds(ctx, rows, edges))
        store.finalize(runs, ctx.calendar, reduce(DataFrame.unionByName, meta), started)
    except BaseException as error:
        store.fail(runs, error, started)
        raise
    return runs


def boundaries(spark: SparkSession, ctx: RunContext) -> DataFrame:
    """Fold edges of both halves."""
    return reduce(
        DataFrame.unionByName,
        [
            ctx.calendar.schedule(name).boundaries(spark).withColumn("split", F.lit(split))
            for split, name in PASSES.items()
        ],
    )


def _engine(ctx: RunContext, spec: ModelSpec) -> dict:
    return {
        "horizon": ctx.horizon,
        "lookback": spec.lookback,
        "scaler": ctx.scaler,
        "val_ratio": ctx.val_ratio,
        "lags": spec.lookback if spec.model.data_format == TABULAR else 0,
    }


def search(
    ctx: RunContext, store: ForecastStore, name: str, seed: int, folds_per_task: int
) -> DataFrame:
    """Per asset: ``params`` (JSON) and score of the best trial, and all trials.

    Tabular fits have no inner validation block and so nothing to score; their
    models run with the parameters they came with.
    """
    spec = ctx.spec(name)
    asset = ctx.panel.asset
    if spec.model.data_format == TABULAR or ctx.n_trials == 0:
        none = [F.lit("{}").alias("params"), F.lit(None).cast("long").alias("best_trial"),
                F.lit(None).cast("double").alias("best_value"), F.lit("[]").alias("trials")]
        return ctx.panel.df.select(asset).distinct().select(asset, *none)
    candidates = tuning.sample_space(spec.search_space, ctx.n_trials, seed)
    losses = tuning.score_grid(
        ctx.panel, ctx.calendar.schedule("in_sample"), spec.model, candidates,
        **_engine(ctx, spec), folds_per_task=folds_per_task,
    )
    kept = store.write_staged(losses, f"{name}-{seed}-hpo")
    scores = tuning.trial_table(tuning.trial_scores(kept, [asset, "trial"]), candidates)
    entry = F.concat(
        F.lit('{"number": '), F.col("trial").cast("string"), F.lit(', "params": '), F.col("params"),
        F.lit(', "value": '), F.col("score").cast("string"), F.lit("}"),
    )
    rank = F.struct("score", "trial")
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("trial"), entry.alias("t")))), lambda e: e["t"]
    )
    return scores.groupBy(asset).agg(
        F.min_by("params", rank).alias("params"),
        F.min_by("trial", rank).alias("best_trial"),
        F.min("score").alias("best_value"),
        F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")).alias("trials"),
    )


def _meta(ctx: RunContext, name: str, seed: int, best: DataFrame) -> DataFrame:
    """One JSON text per run, put together on Spark."""
    spec = ctx.spec(name)
    fixed = {
        "engine_config": ctx.engine_config(name),
        "feature_tag": ctx.tag,
        "architecture": {"model": type(spec.model).__name__, "lookback": spec.lookback},
    }
    hpo = {
        "search_space": {k: list(v) for k, v in spec.search_space.items()},
        "n_trials": ctx.n_trials,
        "sampler": f"random(seed={seed})",
    }
    identity = F.to_json(F.struct("asset", "model", "seed"))

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("null"))

    meta = F.concat(
        F.expr("left(_id, length(_id) - 1)"),
        F.lit(", " + json.dumps(fixed, sort_keys=True)[1:-1]),
        F.lit(', "frozen_hps": '), F.col("params"),
        F.lit(', "hpo": ' + json.dumps(hpo, sort_keys=True)[:-1]),
        F.lit(', "best_trial_number": '), text(F.col("best_trial")),
        F.lit(', "best_value": '), text(F.col("best_value")),
        F.lit(', "trials": '), F.col("trials"), F.lit("}}"),
    )
    return (
        best.withColumnRenamed(ctx.panel.asset, "asset")
        .withColumns({"model": F.lit(name), "seed": F.lit(seed).cast("long")})
        .withColumn("_id", identity)
        .select("asset", "model", "seed", meta.alias("meta"))
    )


def _pass(
    ctx: RunContext, name: str, seed: int, split: str, best: DataFrame, folds_per_task: int
) -> DataFrame:
    """Forecast rows of one half, with the facts of their folds."""
    spec = ctx.spec(name)
    predicted = walkforward.walk_forward(
        ctx.panel, ctx.calendar.schedule(PASSES[split]), spec.model, **_engine(ctx, spec),
        folds_per_task=folds_per_task, params=best,
    )
    anchored = backtest.anchor_predictions(predicted, ctx.panel, ctx.target)
    return anchored.select(
        F.col(ctx.panel.asset).alias("asset"),
        F.lit(name).alias("model"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(split).alias("split"),
        "fold_idx",
        F.col(ctx.panel.time).alias("timestamp"),
        "step",
        F.col("prediction").alias("forecast"),
        "actual",
        "val_loss",
        "val_active",
        "last_train_label_ts",
    )


def _folds(ctx: RunContext, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The fold table: edges from the calendar, facts from the fits, volatility."""
    facts = rows.filter(F.col("step") == 0).select(
        "asset", "model", "seed", "split", "fold_idx", "val_loss", "val_active",
        "last_train_label_ts",
    )
    vols = reduce(
        DataFrame.unionByName,
        [
            ledger.fold_volatility(ctx.panel, ctx.calendar.schedule(name))
            .withColumnRenamed(ctx.panel.asset, "asset")
            .withColumn("split", F.lit(split))
            for split, name in PASSES.items()
        ],
    )
    return facts.join(edges, ["split", "fold_idx"]).join(
        vols, ["asset", "split", "fold_idx"], "left"
    )
