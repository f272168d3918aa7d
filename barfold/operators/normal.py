"""Expanding ridge fits without reading a row twice: mergeable normal equations.

An expanding fold trains on everything before it, so shipping training rows to
folds costs the square of the history. Here the rows are read once. The window
edges of all folds cut a series into stretches; a stretch becomes one record of
joint second moments of its samples (inputs and targets) and of the level and
range of its columns. Records are added up along a block of rows in the task that
makes them. A fold whose edges all lie in the block that begins its series is
solved there, out of the totals at its edges, and hands on its results alone;
other folds get the totals at their edges and, once for all folds that are solved
together, those of the blocks before. All penalties of a search share the
eigenvectors of a fold's small system.

No task holds more than a block of rows with its halo and about ``STRETCHES``
records, or the records of ``FOLDS`` folds; the totals of blocks meet per
series. A record is ``(inputs + targets)**2`` doubles, so wide inputs go another
way (``MOST_INPUTS``). Series must be gap-free (``Panel.on_grid``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.operators import blocks, fitting
from barfold.operators.calendar import Schedule
from barfold.operators.fitting import FoldPlan
from barfold.operators.folds import fold_position
from barfold.operators.models import SEQUENCE, Forecaster, RidgeDMS, RidgeSequence
from barfold.operators.moments import Moments, Ridge, mean_squared_error
from barfold.operators.samples import inner_split_size
from barfold.panel import Panel
from barfold.session import stored

#: Most inputs of a model that is fitted from moments.
MOST_INPUTS = 512
#: About so many stretches are in one block; folds that one task takes together.
STRETCHES = 256
FOLDS = 16
BLOCK_ROWS = 4096
#: About so many rows are in the blocks of one task.
TASK_ROWS = 1 << 16
#: Most doubles of records that are solved or handed on at once, one record at least.
AT_ONCE = 1 << 20
#: Folds of all series whose edges are found by one task, and rows of edges that it hands on at once.
TASK_FOLDS = 1 << 15
EDGE_ROWS = 1 << 16


def applies(plan: FoldPlan, panel: Panel, model: Forecaster) -> bool:
    """Is this an expanding ridge fit over gap-free series whose records stay small?"""
    if type(model) not in (RidgeDMS, RidgeSequence) or not plan.expanding or not panel.grid_seconds:
        return False
    return plan.method in (None, "standard", "minmax") and Layout.of(plan, model).inputs <= MOST_INPUTS


def same_inputs(model: Forecaster, params: Mapping) -> bool:
    """Does a candidate differ from the model in its penalty alone?"""
    return model.tuned(dict(params)).input_columns == model.input_columns


@dataclass(frozen=True)
class Layout:
    """Which columns a record is made of."""

    plan: FoldPlan
    names: tuple[str, ...]
    picked: tuple[int, ...]
    sequence: bool

    @classmethod
    def of(cls, plan: FoldPlan, model: Forecaster) -> Layout:
        names = (*plan.features, *[f"log_return_lag_{k}" for k in range(1, plan.lags + 1)])
        picked = fitting.input_positions(plan, model)
        return cls(plan, names, tuple(range(len(names)) if picked is None else picked), model.data_format == SEQUENCE)

    @property
    def lookback(self) -> int:
        return self.plan.lookback if self.sequence else 0

    @property
    def inputs(self) -> int:
        return len(self.picked) * max(1, self.lookback)

    @property
    def reach(self) -> int:
        """Positions from a sample's first row to the one after its last."""
        return self.lookback + self.plan.horizon

    def windows(self, first: int, fold: np.ndarray) -> dict[str, np.ndarray]:
        """Ends of each fold's windows on a series that is usable from ``first`` on.

        ``rows``: of the rows that scale; ``train``: of the samples' first rows;
        ``val_from``, ``val_to``: of the validation samples' (equal if there are none).
        """
        plan, h = self.plan, self.plan.horizon
        begin = max(first, plan.origin)
        n = plan.origin + fold * plan.step + plan.train - begin
        kept = np.where(n > h, n - h, n)
        out = {"begin": np.full(len(fold), begin), "n": n, "rows": begin + kept}
        if not self.sequence:
            train = begin + kept - h
            return out | {"train": train, "val_from": train, "val_to": train}
        size = [inner_split_size(int(k), self.lookback, h, plan.val_ratio) for k in kept]
        size = np.array([0 if s is None else s for s in size], dtype=np.int64)
        train = begin + kept - size - self.reach + 1
        val_to = begin + kept - self.reach + 1
        val_from = np.where(size > 0, begin + kept - size, val_to)
        return out | {"train": train, "val_from": val_from, "val_to": val_to}

    def edges(self, first: int) -> np.ndarray:
        """All edges of a series in ascending order; stretch ``k`` lies between edges ``k`` and ``k + 1``."""
        w = self.windows(first, np.arange(self.plan.n_folds, dtype=np.int64))
        begin = max(first, self.plan.origin)
        every = np.unique(np.concatenate([[begin], *[w[k] for k in ROLES]]))
        return every[every >= begin]


ROLES = ("rows", "train", "val_from", "val_to")


def _record_fields() -> list[T.StructField]:
    array = T.ArrayType(T.DoubleType())
    return [
        T.StructField("n", T.DoubleType()),
        T.StructField("mean", array),
        T.StructField("dev", array),
        T.StructField("row_n", T.DoubleType()),
        T.StructField("row_mean", array),
        T.StructField("row_dev", array),
        T.StructField("low", array),
        T.StructField("high", array),
        T.StructField("bad", T.DoubleType()),
    ]


@dataclass
class Record:
    """Joint moments of samples; level, spread and range of rows; rows that are not finite."""

    joint: Moments
    rows: Moments
    low: np.ndarray
    high: np.ndarray
    bad: float

    def plus(self, other: Record) -> Record:
        return Record(
            self.joint.plus(other.joint), self.rows.plus(other.rows),
            np.minimum(self.low, other.low), np.maximum(self.high, other.high), self.bad + other.bad,
        )

    def packed(self, joint: bool = True) -> dict:
        samples = {"n": self.joint.n, "mean": self.joint.mean, "dev": self.joint.dev.ravel()} if joint else {"n": 0.0}
        return samples | {
            "row_n": self.rows.n, "row_mean": self.rows.mean, "row_dev": self.rows.dev,
            "low": self.low, "high": self.high, "bad": self.bad,
        }

    @classmethod
    def unpacked(cls, row) -> Record:
        # Edges of scaling rows come without joint moments.
        mean = np.zeros(0) if row["mean"] is None else np.asarray(row["mean"])
        dev = np.zeros(0) if row["dev"] is None else np.asarray(row["dev"])
        return cls(
            Moments(row["n"], mean, dev.reshape(len(mean), len(mean))),
            Moments(row["row_n"], np.asarray(row["row_mean"]), np.asarray(row["row_dev"])),
            np.asarray(row["low"]), np.asarray(row["high"]), row["bad"],
        )


def _totals(samples: np.ndarray, rows: np.ndarray, fine: np.ndarray, cuts: np.ndarray) -> list[Record]:
    """Totals from the first cut up to each of the others, merged as by ``Record.plus``.

    ``cuts`` ascend; the last ones may lie behind the samples.
    """
    out, n = [], np.diff(cuts)
    at, here = cuts[:-1] - cuts[0], rows[cuts[0] : cuts[-1]]
    row_n, row_mean, off, step, weight = _levels(here, n, at)
    row_dev = np.add.reduceat(off * off, at, axis=0)
    row_dev[1:] += step * step * weight[:, None]
    row_dev = row_dev.cumsum(axis=0)
    low = np.minimum.accumulate(np.minimum.reduceat(here, at, axis=0), axis=0)
    high = np.maximum.accumulate(np.maximum.reduceat(here, at, axis=0), axis=0)
    bad = np.add.reduceat((~fine[cuts[0] : cuts[-1]]).astype(float), at).cumsum()
    inside = np.minimum(cuts, max(len(samples), int(cuts[0])))
    some = int(np.count_nonzero(np.diff(inside)))
    width = samples.shape[1]
    dev = np.zeros((max(some, 1), width, width))
    joint_n, mean = np.zeros(1), np.zeros((1, width))
    if some:
        n, at = np.diff(inside)[:some], inside[:some] - inside[0]
        joint_n, mean, off, step, weight = _levels(samples[inside[0] : inside[-1]], n, at)
        for k in range(some):
            part = off[at[k] : at[k] + n[k]]
            np.matmul(part.T, part, out=dev[k])
            if k:
                dev[k] += (step[k - 1] * weight[k - 1])[:, None] * step[k - 1]
                dev[k] += dev[k - 1]
    for k in range(len(cuts) - 1):
        j = min(k, max(some, 1) - 1)
        out.append(
            Record(
                Moments(float(joint_n[j]), mean[j], dev[j]), Moments(float(row_n[k]), row_mean[k], row_dev[k]),
                low[k], high[k], float(bad[k]),
            )
        )
    return out


def _levels(values: np.ndarray, n: np.ndarray, at: np.ndarray):
    """Of stretches of ``n`` rows from ``at`` on: running counts and means, deviations from the mean of
    each stretch, and how far and with which weight each but the first lies from what is before it."""
    own = np.add.reduceat(values, at, axis=0) / n[:, None]
    upto = n.cumsum()
    mean = own[0] + ((own - own[0]) * n[:, None]).cumsum(axis=0) / upto[:, None]
    return upto, mean, values - np.repeat(own, n, axis=0), own[1:] - mean[:-1], upto[:-1] * n[1:] / upto[1:]


def _frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    def column(field: T.StructField) -> pd.Series:
        values = [r.get(field.name) for r in rows]
        plain = not isinstance(field.dataType, T.ArrayType) and not any(v is None for v in values)
        return pd.Series(values, dtype=None if plain else object)

    return pd.DataFrame({f.name: column(f) for f in schema.fields})


def _halo_rows(panel: Panel, schedule: Schedule, layout: Layout, spans: DataFrame, block_rows: int) -> DataFrame:
    plan = layout.plan
    columns = [*plan.features, *plan.labels, *([plan.lag_price] if plan.lags else [])]
    slim = panel.df.select(panel.asset, fold_position(panel, schedule).alias(blocks.POS), *dict.fromkeys(columns))
    last = plan.origin + (plan.n_folds - 1) * plan.step + plan.train + plan.horizon
    used = (F.col(blocks.POS) >= plan.origin - plan.lags - 1) & (F.col(blocks.POS) < last)
    cut = blocks.with_halo(
        slim.filter(used), before=plan.lags + 1 if plan.lags else 0, after=layout.reach, block_rows=block_rows
    )
    return cut.drop(blocks.CORE).join(spans.drop("_last"), panel.asset)


def _block_records(layout: Layout, asset: str, block_rows: int, schema: T.StructType):
    """The records of one block as a table."""
    rows = _block_rows(layout, asset, block_rows)
    return lambda key, pdf: _frame(rows(key, pdf), schema)


def _each_block(asset: str, rows, schema: T.StructType, at_once: int):
    """What ``rows`` makes of one block after another, out of rows in order of series, block and position.

    Tables of some ``at_once`` records are handed on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out = None, []
        for frame in itertools.chain(frames, [None]):
            ended = frame is None
            frame = rest if ended else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if frame is None or not len(frame):
                continue
            name, block = frame[asset].to_numpy(), frame[blocks.BLOCK].to_numpy()
            cuts = [0, *(np.flatnonzero((name[1:] != name[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
            # More rows of the last block may follow.
            for a, b in itertools.pairwise([*cuts, len(frame)] if ended else cuts):
                out += rows((name[a], int(block[a])), frame.iloc[a:b])
                if len(out) >= at_once:
                    yield _frame(out, schema)
                    out = []
            rest = frame.iloc[cuts[-1] :]
        if out:
            yield _frame(out, schema)

    return run


def _block_rows(layout: Layout, asset: str, block_rows: int, solve=None):
    """Records of the stretches of one block, and the inputs of the folds that begin their forecast in it.

    ``solve`` makes results of a fold out of its totals; folds that lie in the block with all
    that is before them become results, and only the others' stretches and inputs are handed on.
    """
    plan, known = layout.plan, {}
    starts = plan.origin + np.arange(plan.n_folds, dtype=np.int64) * plan.step + plan.train

    def shape(first: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        if first not in known:  # series that begin together have the same edges
            known.clear()
            known[first] = layout.windows(first, np.arange(plan.n_folds, dtype=np.int64)), layout.edges(first)
        return known[first]

    def run(key: tuple, pdf: pd.DataFrame) -> list[dict]:
        pos = pdf[blocks.POS].to_numpy()
        if (np.diff(pos) != 1).any():
            raise ValueError(f"{key[0]}: the series has holes or repeated rows; verify its grid")
        low, high = key[1] * block_rows, (key[1] + 1) * block_rows
        x = pdf[list(plan.features)].to_numpy(dtype=float)
        y = pdf[list(plan.labels)].to_numpy(dtype=float)
        if plan.lags:
            x = fitting.with_lags(x, pdf[plan.lag_price].to_numpy(dtype=float), plan.lags)
        # Lags of a series need rows before them; without these a row is left out.
        first = int(pdf["_first"].iloc[0]) + (plan.lags + 1 if plan.lags else 0)
        begin = max(first, plan.origin)
        w, edges = shape(first)
        base = np.hstack([x, y])
        fine = np.isfinite(base).all(axis=1)
        safe = np.where(np.isfinite(base), base, 0.0)
        count = len(pos) - layout.reach + 1 if layout.sequence else len(pos) - plan.horizon + 1
        inputs = safe[:, list(layout.picked)]
        if count > 0:
            ahead = sliding_window_view(safe[:, x.shape[1] :], plan.horizon, axis=0).swapaxes(1, 2)
            if layout.sequence:
                past = sliding_window_view(inputs, layout.lookback, axis=0)[:count].swapaxes(1, 2)
                samples = np.hstack([past.reshape(count, -1), ahead[layout.lookback : layout.lookback + count].reshape(count, -1)])
            else:
                samples = np.hstack([inputs[:count], ahead[:count, :, 0]])
        else:
            count, samples = 0, np.zeros((0, layout.inputs + plan.horizon * len(plan.labels)))
        # Totals of the block up to the end of each stretch that ends in it.
        own_from, own_to = max(low, begin), min(high, int(pos[-1]) + 1, int(edges[-1]))
        ends = np.unique([*edges[(edges > own_from) & (edges < own_to)], own_to]) if own_from < own_to else np.zeros(0, dtype=np.int64)
        totals = _totals(samples, safe, fine, np.array([own_from, *ends]) - pos[0]) if len(ends) else []
        begins = (starts - layout.lookback >= low) & (starts - layout.lookback < high)
        mine = begins & (w["n"] > 0) & (begin >= low) & (w["rows"] <= own_to) & (solve is not None)
        rest, cells = ~mine & (w["n"] > 0), np.searchsorted(edges, ends, "left") - 1
        scaling = edges if solve is None else w["rows"][rest]
        # Where only scaling rows end, nothing is read of the samples.
        fitted = np.isin(ends, edges if solve is None else np.concatenate([w[role][rest] for role in ROLES[1:]]))
        out = []
        for k in np.flatnonzero(fitted | np.isin(ends, scaling)).tolist():
            out.append({asset: key[0], "kind": "stretch", "id": int(cells[k]), "block": key[1]} | totals[k].packed(joint=fitted[k]))
        if totals and edges[-1] > high:  # later blocks add this to theirs
            out.append({asset: key[0], "kind": "block", "id": -1, "block": key[1]} | totals[-1].packed())
        places, ready = {role: np.searchsorted(ends, w[role]) for role in ROLES}, []
        # Folds whose inputs begin in this block.
        for fold in np.flatnonzero(begins).tolist():
            a, b = np.searchsorted(pos, [starts[fold] - layout.lookback, starts[fold]])
            c = int(np.searchsorted(pos, starts[fold] + min(plan.test, plan.horizon)))
            if b == c:
                continue
            seen = (x[a:b] if layout.sequence else x[b : b + 1])[:, list(layout.picked)].ravel()
            if mine[fold]:
                whole = {role: totals[places[role][fold]] for role in ROLES if w[role][fold] > begin}
                ready.append((fold, int(w["n"][fold]), whole, seen, c - b))
            else:
                out.append({asset: key[0], "kind": "fold", "id": fold, "n": float(c - b), "mean": seen})
        if ready:
            chosen = pdf["_params"].iloc[0] if "_params" in pdf else None
            out += [{asset: key[0], "kind": "result"} | row for row in solve(key[0], ready, chosen)]
        return out

    return run


def _carried(asset: str, schema: T.StructType):
    """What lies before each block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, out = None, []
        for row in pdf.sort_values("block", kind="stable").to_dict("records"):
            record = Record.unpacked(row)
            total = record if total is None else total.plus(record)
            out.append({asset: key[0], "block": int(row["block"]) + 1} | total.packed())
        return _frame(out, schema)

    return run


def _fold_edges(layout: Layout, asset: str, schema: T.StructType):
    """For each fold the last stretch before each of its edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Series with the same span have the same edges.
            for (begin, last, low, high), same in frame.groupby(["_first", "_last", "_low", "_high"]):
                fold = np.arange(low, high, dtype=np.int64)
                if not len(fold):
                    continue
                first = int(begin) + (layout.plan.lags + 1 if layout.plan.lags else 0)
                w = layout.windows(first, fold)
                starts = layout.plan.origin + fold * layout.plan.step + layout.plan.train
                able = (w["n"] > 0) & (starts <= last)
                edges = layout.edges(first)
                cells = pd.concat(
                    pd.DataFrame({"fold_idx": fold, "role": role, "id": np.searchsorted(edges, w[role], "left") - 1, "rows": w["n"]})[able]
                    for role in ROLES
                )
                names, at_once = same[asset].to_numpy(), max(1, EDGE_ROWS // max(1, len(cells)))
                for a in range(0, len(names), at_once):
                    some = names[a : a + at_once]
                    out = cells.iloc[np.tile(np.arange(len(cells)), len(some))]
                    yield out.assign(**{asset: np.repeat(some, len(cells))})[[asset, *cells.columns]]

    return run


def _fold_table(panel: Panel, schedule: Schedule, layout: Layout, spans: DataFrame) -> DataFrame:
    plan, asset = layout.plan, panel.asset
    kind = panel.df.schema[asset].dataType
    schema = T.StructType(
        [T.StructField(asset, kind), T.StructField("fold_idx", T.LongType()), T.StructField("role", T.StringType()),
         T.StructField("id", T.LongType()), T.StructField("rows", T.LongType())]
    )
    step = 4096
    chunks = blocks.explode_range(spans, "_chunk", F.lit(0), F.lit((plan.n_folds - 1) // step))
    ranges = chunks.withColumns({"_low": F.col("_chunk") * step, "_high": F.least(F.lit(plan.n_folds), (F.col("_chunk") + 1) * step)})
    # Spans are few bytes, which Spark would leave to one task; their folds are many.
    tasks = max(1, -(-spans.count() * plan.n_folds // TASK_FOLDS))
    return ranges.repartition(tasks, asset, "_chunk").mapInPandas(_fold_edges(layout, asset, schema), schema)


@dataclass
class Batch:
    """Folds of one series, stacked and ready for any penalty."""

    ridge: Ridge
    x_scale: np.ndarray
    y_scale: np.ndarray
    val: Moments
    inputs: int
    known: dict[float, tuple]

    def fitted(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights and validation losses of all folds."""
        if alpha not in self.known:
            weights = self.ridge.weights(alpha)
            some = Moments(np.where(self.val.n > 0, self.val.n, 1.0), self.val.mean, self.val.dev)
            self.known[alpha] = weights, mean_squared_error(self.ridge, weights, some, self.inputs, self.x_scale, self.y_scale)
        return self.known[alpha]


@dataclass
class Solved:
    """One fold, ready for any penalty: its place in a batch."""

    fold: int
    last: int
    batch: Batch
    place: int

    def loss(self, alpha: float) -> float | None:
        return float(self.batch.fitted(alpha)[1][self.place]) if self.batch.val.n[self.place] else None

    def forecast(self, alpha: float, seen: np.ndarray) -> np.ndarray:
        batch, k = self.batch, self.place
        off = seen / batch.x_scale[k] - batch.ridge.x_mean[k]
        return (batch.ridge.y_mean[k] + off @ batch.fitted(alpha)[0][k]) * batch.y_scale[k]


def _stacked(parts: Sequence[Moments]) -> Moments:
    return Moments(np.array([m.n for m in parts]), np.stack([m.mean for m in parts]), np.stack([m.dev for m in parts]))


def _solved(layout: Layout, name: str, folds: Sequence[tuple[int, int, Mapping[str, Record]]]) -> list[Solved]:
    """Folds of one series, each with the number of its rows and the totals at its edges."""
    plan = layout.plan
    for fold, rows, totals in folds:
        if totals["rows"].bad:
            raise ValueError(f"{name} fold {fold}: missing values or infinities in training rows")
        if "train" not in totals or totals["train"].joint.n < 1:
            raise ValueError(f"{name} fold {fold}: {rows} rows are too few for horizon {plan.horizon}")
    scale = [totals["rows"] for _, _, totals in folds]
    low, high = np.stack([r.low for r in scale]), np.stack([r.high for r in scale])
    if plan.method == "standard":
        level = _stacked([r.rows for r in scale])
        spread = np.sqrt(np.maximum(level.dev / level.n[:, None], 0.0))
    elif plan.method == "minmax":
        spread = high - low
    else:
        spread = np.ones(low.shape)
    spread = np.where((low == high) | (spread == 0), 1.0, spread)
    n = len(layout.names)
    if plan.scaled:
        spread[:, :n] = np.where([c in plan.scaled for c in layout.names], spread[:, :n], 1.0)
    if not plan.scale_labels:
        spread[:, n:] = 1.0
    x_scale = np.tile(spread[:, list(layout.picked)], max(1, layout.lookback))
    y_scale = np.tile(spread[:, n:] if layout.sequence else spread[:, n : n + 1], plan.horizon)
    joint = _stacked([totals["train"].joint for _, _, totals in folds])
    empty = Moments(0.0, np.zeros_like(joint.mean[0]), np.zeros_like(joint.dev[0]))
    val = []
    for _, _, totals in folds:
        upto, part = (totals[k].joint if k in totals and layout.sequence else empty for k in ("val_to", "val_from"))
        val.append(upto.minus(part))
    batch = Batch(Ridge.of(joint, layout.inputs, x_scale, y_scale), x_scale, y_scale, _stacked(val), layout.inputs, {})
    last = layout.windows(plan.origin, np.array([fold for fold, _, _ in folds]))["rows"] - 1
    return [Solved(fold, int(last[k]), batch, k) for k, (fold, _, _) in enumerate(folds)]


def solve_folds(
    panel: Panel,
    schedule: Schedule,
    plan: FoldPlan,
    model: Forecaster,
    emit,
    result: T.StructType,
    *,
    params: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows of ``result``: ``emit(asset, solved, seen, n_test, params)`` for every fold with a test row."""
    layout, asset = Layout.of(plan, model), panel.asset
    kind = panel.df.schema[asset].dataType
    position = fold_position(panel, schedule)
    spans = stored(panel.df.groupBy(asset).agg(F.min(position).alias("_first"), F.max(position).alias("_last")))
    known = spans
    if params is not None:
        known = spans.join(params.select(asset, F.col("params").alias("_params")), asset, "left")
    head = [T.StructField(asset, kind), T.StructField("id", T.LongType())]
    # A result keeps its columns under numbers, as their names may be those of a record.
    fields = [f for f in result.fields if f.name != asset]
    results = [T.StructField(f"_r{k}", f.dataType) for k, f in enumerate(fields)]
    found = T.StructType(
        [head[0], T.StructField("kind", T.StringType()), head[1], T.StructField("block", T.LongType()), *_record_fields(), *results]
    )

    at_once = max(1, AT_ONCE // (layout.inputs + plan.horizon * len(plan.labels)) ** 2)

    def solve(name, folds: Sequence[tuple], chosen: str | None) -> Iterator[dict]:
        params = json.loads(chosen or "{}")
        for a in range(0, len(folds), at_once):
            some = folds[a : a + at_once]
            for solved, (*_, seen, n_test) in zip(_solved(layout, str(name), [f[:3] for f in some]), some, strict=True):
                yield from emit(name, solved, seen, n_test, params)

    def numbered(*args) -> list[dict]:
        return [{f"_r{k}": row[f.name] for k, f in enumerate(fields)} for row in solve(*args)]

    # A fold has four edges.
    block_rows = min(block_rows, max(layout.reach, plan.lags + 1, STRETCHES * plan.step // len(ROLES)))
    halo = _halo_rows(panel, schedule, layout, known, block_rows)
    # Left to the size of its rows, Spark would merge the blocks into few tasks, whose work is in Python.
    n_rows = spans.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    cut = halo.repartition(max(1, -(-n_rows // TASK_ROWS)), asset, blocks.BLOCK).sortWithinPartitions(asset, blocks.BLOCK, blocks.POS)
    made = _each_block(asset, _block_rows(layout, asset, block_rows, numbered), found, at_once)
    records = stored(cut.mapInPandas(made, found))
    named = {f.name: F.col(asset) if f.name == asset else F.col(f"_r{fields.index(f)}") for f in result.fields}
    done = records.filter(F.col("kind") == "result").select(*[c.alias(k) for k, c in named.items()])
    rest = records.drop(*[f.name for f in results])
    upto = rest.filter(F.col("kind") == "stretch").drop("kind")
    if upto.isEmpty():  # no series goes over several blocks
        return done

    names = [f.name for f in _record_fields()]
    before = T.StructType([head[0], T.StructField("block", T.LongType()), *_record_fields()])
    totals = rest.filter(F.col("kind") == "block").select(asset, "block", *names)
    carry = totals.groupBy(asset).applyInPandas(_carried(asset, before), before)

    # Scaling rows have no use for joint moments.
    joint = F.col("role") != "rows"
    thin = {"n": F.when(joint, F.col("n")).otherwise(0.0), "mean": F.when(joint, F.col("mean")), "dev": F.when(joint, F.col("dev"))}
    chunk = blocks.floor_div(F.col("fold_idx"), FOLDS).alias("_chunk")
    none = F.lit(None).cast("long")
    ends = _fold_table(panel, schedule, layout, spans).filter("id >= 0")
    placed = stored(ends.join(upto.select(asset, "id", "block"), [asset, "id"]))
    inside = placed.drop("block").join(upto, [asset, "id"]).select(
        asset, chunk, "fold_idx", "role", "rows", "block", *[thin[k].alias(k) if k in thin else k for k in names]
    )
    # Folds that are solved together share what lies before a block.
    ahead = placed.select(asset, chunk, "block").distinct().join(carry, [asset, "block"]).select(
        asset, "_chunk", none.alias("fold_idx"), F.lit("before").alias("role"), none.alias("rows"), "block", *names
    )
    seen = rest.filter(F.col("kind") == "fold").select(
        asset, blocks.floor_div(F.col("id"), FOLDS).alias("_chunk"), F.col("id").alias("fold_idx"),
        F.lit("seen").alias("role"), none.alias("rows"), none.alias("block"), *names
    )
    parts = inside.unionByName(ahead).unionByName(seen)
    tuned = params is not None
    if tuned:
        parts = parts.join(known.select(asset, "_params"), asset, "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ready, by_fold, ahead, chosen = [], {}, {}, None
        for row in pdf.to_dict("records"):
            if row["role"] == "before":
                ahead[int(row["block"])] = Record.unpacked(row)
            else:
                by_fold.setdefault(int(row["fold_idx"]), {})[row["role"]] = row
        for fold, by_role in sorted(by_fold.items()):
            if "seen" not in by_role or len(by_role) == 1:
                continue
            whole = {}
            for role in ROLES:
                if role in by_role:
                    here, earlier = Record.unpacked(by_role[role]), ahead.get(int(by_role[role]["block"]))
                    whole[role] = here if earlier is None else earlier.plus(here)
            rows = max(int(by_role[r]["rows"]) for r in whole)
            if "rows" not in whole:
                raise ValueError(f"{key[0]} fold {fold}: {rows} rows are too few for horizon {plan.horizon}")
            head = by_role["seen"]
            chosen = head["_params"] if tuned else None
            ready.append((fold, rows, whole, np.asarray(head["mean"]), int(head["n"])))
        return _frame(list(solve(key[0], ready, chosen)), result)

    return done.unionByName(parts.groupBy(asset, "_chunk").applyInPandas(run, result))


def forecast_rows(plan: FoldPlan, model: Forecaster, asset: str, outs: Sequence[str]):
    """``emit`` of ``solve_folds`` for forecasts: one row for each test row."""
    layout = Layout.of(plan, model)

    def emit(name, solved: Solved, seen: np.ndarray, n_test: int, chosen: dict) -> list[dict]:
        if not np.isfinite(seen).all():
            raise ValueError(f"{name} fold {solved.fold}: missing values in test features")
        if len(seen) != layout.inputs:
            raise ValueError(f"{name} fold {solved.fold}: its inputs are {len(seen)} values instead of {layout.inputs}")
        alpha = model.tuned(chosen).alpha
        values = solved.forecast(alpha, seen).reshape(plan.horizon, len(outs))
        if n_test != plan.horizon:
            raise ValueError(f"{name} fold {solved.fold}: forecast of {plan.horizon} steps for {n_test} test rows")
        start, loss = plan.edges(solved.fold)[1], solved.loss(alpha)
        return [
            {asset: name, "fold_idx": solved.fold, "step": k, "_pos": start + k, "val_loss": np.nan if loss is None else loss,
             "val_active": loss is not None, "_last": solved.last} | {c: values[k, n] for n, c in enumerate(outs)}
            for k in range(plan.horizon)
        ]

    return emit


def loss_rows(model: Forecaster, asset: str, candidates: Sequence[Mapping]):
    """``emit`` of ``solve_folds`` for a search: one row for each candidate."""

    def emit(name, solved: Solved, seen: np.ndarray, n_test: int, chosen: dict) -> list[dict]:
        return [
            {asset: name, "trial": k, "fold_idx": solved.fold, "val_loss": solved.loss(model.tuned(dict(c)).alpha)}
            for k, c in enumerate(candidates)
        ]

    return emit
