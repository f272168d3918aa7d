"""The forecast store: partitioned tables of forecasts, folds and run state.

    <root>/forecasts   write=/gen=
    <root>/folds       write=/gen=
    <root>/meta        write=/gen=
    <root>/writes      one small file for each write: what it holds
    <root>/status      one small file for each change of state
    <root>/config      name=

Many runs (asset, model, seed) are written and checked in one job each. A write
is one folder, whose files hold many runs in the order of their names, so files
grow with the rows and not with the number of runs. Every ``begin`` opens a new
generation; nothing of an earlier one is touched. What a run stores goes to its
open generation. ``writes`` tells which runs (and halves) a write holds; of a
run and half the last such write is read, as a whole, so a retried step leaves
no mix. ``status`` is a journal: the row that says ``complete`` names the
generation, and writing it is the one step that switches readers over. A writer
that dies anywhere leaves the last committed generation to be read. ``clean``
removes generations that nobody can read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Collection, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barfold import schema
from barfold.operators import blocks, quality
from barfold.operators.calendar import Calendar
from barfold.panel import HOUR, Panel
from barfold.schema import RUN_KEYS, SPLITS
from barfold.session import stored

Run = tuple[str, str, int]

#: What a write replaces as a whole.
UNITS = {"forecasts": [*RUN_KEYS, "split"], "folds": RUN_KEYS, "meta": RUN_KEYS}
#: Most values of a key that a scan is told; more are left to the join.
LISTED = 64


class StoreError(ValueError):
    """Store contents or calls that break the contract."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _name() -> str:
    """A new name; later ones come after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class ForecastStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- plain reads and writes ------------------------------------------------

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, ddl: str) -> DataFrame:
        """A stored table under its declared schema; empty where nothing was stored."""
        try:
            return self.spark.read.schema(ddl).parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _replace(self, df: DataFrame, table: str, parts: Sequence[str]) -> None:
        """Replace exactly the partitions that ``df`` has rows for."""
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(self._path(table))
        )

    def _runs(self, runs: Sequence[Run]) -> DataFrame:
        rows = [(a, m, int(s)) for a, m, s in runs]
        return self.spark.createDataFrame(rows, "asset string, model string, seed long")

    def _of_runs(self, df: DataFrame, runs: Sequence[Run]) -> DataFrame:
        """Rows of the given runs; short lists of values reach the scan."""
        for n, name in enumerate(RUN_KEYS):
            df = _listed(df, name, {r[n] for r in runs})
        return df.join(self._runs(runs), RUN_KEYS, "left_semi")

    # -- generations -------------------------------------------------------------

    def _journal(self) -> DataFrame:
        return self._read("status", schema.STATUS)

    def _states(self, runs: Sequence[Run]) -> dict[Run, Row]:
        """Of each run its present ``status``, the generation last begun (``open``) and that
        last committed (``done``, if any); runs that were never begun are left out."""
        rows = self._of_runs(self._journal(), runs)
        last = rows.groupBy(*RUN_KEYS).agg(
            F.max_by("status", "at").alias("status"),
            F.max_by("gen", "at").alias("open"),
            F.max_by("gen", F.when(F.col("status") == "complete", F.col("at"))).alias("done"),
        )
        return {(r.asset, r.model, int(r.seed)): r for r in last.collect()}

    def _generations(self, runs: Sequence[Run], *, committed: bool) -> dict[Run, str]:
        """Of each run the generation last committed, or last begun; runs without one are left out."""
        found = {run: r.done if committed else r.open for run, r in self._states(runs).items()}
        return {run: gen for run, gen in found.items() if gen is not None}

    def _stored(
        self, table: str, ddl: str, runs: Sequence[Run], *, committed: bool = False,
        gens: Mapping[Run, str] | None = None,
    ) -> DataFrame:
        """Rows of the runs' open generations, or of their committed ones."""
        gens = self._generations(runs, committed=committed) if gens is None else gens
        rows = [(*run, gen) for run, gen in gens.items()]
        known = self.spark.createDataFrame(rows, "asset string, model string, seed long, gen string")
        told = self._read("writes", schema.WRITES).filter(F.col("table") == table)
        # One row per run and half. Stored, so that its size is known where it is joined.
        last = stored(
            told.join(known, [*RUN_KEYS, "gen"], "left_semi")
            .groupBy(*UNITS[table], "gen")
            .agg(F.max("write").alias("write"))
        )
        kept = self._read(table, f"write string, gen string, {ddl}")
        for n, name in enumerate(RUN_KEYS):
            kept = _listed(kept, name, {run[n] for run in gens})
        kept = _listed(kept, "gen", set(gens.values()))
        # A half that is NULL is found too, and refused by ``check_forecasts``.
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*UNITS[table], "gen", "write")]
        found = kept.alias("a").join(last.alias("b"), reduce(and_, same), "left_semi")
        return found.drop("write", "gen")

    def _write(self, df: DataFrame, table: str, *spread: Column) -> None:
        """Replace what ``df`` has rows for in the open generations of its runs.

        ``spread`` deals the rows of a large run to several tasks. The write counts from
        the moment its rows of ``writes`` are there.
        """
        opened = self._journal().groupBy(*RUN_KEYS).agg(F.max_by("gen", "at").alias("gen"))
        joined = df.join(opened, RUN_KEYS, "left")
        name = F.concat_ws(" / ", *[F.col(k).cast("string") for k in RUN_KEYS])
        gen = F.coalesce("gen", F.raise_error(F.concat(F.lit("run was not begun: "), name)).cast("string"))
        keys, write = UNITS[table], _name()
        out = joined.withColumn("gen", gen).repartition("gen", *keys, *spread)
        path = f"{self._path(table)}/write={write}"
        out.sortWithinPartitions("gen", *keys).write.partitionBy("gen").parquet(path)
        held = self.spark.read.schema(out.schema).parquet(path).select(*keys, "gen").distinct()
        split = F.col("split") if "split" in keys else F.lit(None).cast("string")
        rows = held.select(
            F.lit(table).alias("table"), *RUN_KEYS, split.alias("split"), "gen", F.lit(write).alias("write")
        )
        rows.coalesce(1).write.mode("append").parquet(self._path("writes"))

    def clean(self) -> list[str]:
        """Delete the generations that are neither committed nor last begun by any run; their names."""
        journal = self._journal()
        last = journal.groupBy(*RUN_KEYS).agg(
            F.max_by("gen", "at").alias("open"),
            F.max_by("gen", F.when(F.col("status") == "complete", F.col("at"))).alias("done"),
        )
        used = last.select(F.explode(F.array("open", "done")).alias("gen")).distinct()
        old = sorted(r.gen for r in journal.select("gen").distinct().join(used, "gen", "left_anti").collect())
        held = self._read("writes", schema.WRITES).select("table", "write", "gen").distinct()
        for r in held.join(used, "gen", "left_anti").collect():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(r.table)}/write={r.write}/gen={r.gen}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return old

    # -- state of runs -----------------------------------------------------------

    def status(self, runs: Sequence[Run]) -> DataFrame:
        """The present state of each run."""
        rows = self._of_runs(self._journal(), runs)
        columns = [c for c in rows.columns if c not in RUN_KEYS]
        last = rows.groupBy(*RUN_KEYS).agg(F.max_by(F.struct(*columns), "at").alias("s"))
        return last.select(*RUN_KEYS, "s.*")

    def _write_status(self, rows: DataFrame, gens: Mapping[Run, str]) -> None:
        """One file, so that a change of state is there as a whole or not at all."""
        columns = self.spark.createDataFrame([], schema.STATUS).columns
        known = self.spark.createDataFrame(
            [(*run, gen) for run, gen in gens.items()], "asset string, model string, seed long, gen string"
        )
        stamped = rows.join(known, RUN_KEYS).withColumn("at", F.lit(time.time_ns()))
        stamped.select(*columns).coalesce(1).write.mode("append").parquet(self._path("status"))

    def _state(self, runs: Sequence[Run], state: str, error: str | None, started: str | None):
        done = _now() if state in ("complete", "failed") else None
        return self._runs(runs).select(
            *RUN_KEYS,
            F.lit(state).alias("status"),
            F.lit(started).cast("string").alias("started_at"),
            F.lit(done).cast("string").alias("finished_at"),
            F.lit(error).cast("string").alias("error"),
        )

    def _counts(self, runs: Sequence[Run]) -> DataFrame:
        rows = self._stored("forecasts", schema.FORECASTS, runs)
        per = rows.groupBy(*RUN_KEYS, "split", "fold_idx").agg(F.count(F.lit(1)).alias("n"))

        def split(name, value):
            return F.coalesce(F.sum(F.when(F.col("split") == name, value)), F.lit(0))

        return per.groupBy(*RUN_KEYS).agg(
            split("oos", F.lit(1)).alias("n_folds_oos"),
            split("in_sample", F.lit(1)).alias("n_folds_insample"),
            split("oos", F.col("n")).alias("n_rows_oos"),
            split("in_sample", F.col("n")).alias("n_rows_insample"),
        )

    def _with_counts(self, state: DataFrame, runs: Sequence[Run]) -> DataFrame:
        names = ["n_folds_oos", "n_folds_insample", "n_rows_oos", "n_rows_insample"]
        joined = state.join(self._counts(runs), RUN_KEYS, "left")
        return joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})

    def begin(self, runs: Sequence[Run]) -> str:
        """Open a new, empty generation of these runs and mark them running.

        What they committed before stays readable until the new one is complete.
        """
        if not runs:
            raise StoreError("no runs given")
        started = _now()
        gen = _name()
        zero = {
            n: F.lit(0).cast("long")
            for n in ("n_folds_oos", "n_folds_insample", "n_rows_oos", "n_rows_insample")
        }
        state = self._state(runs, "running", None, started).withColumns(zero)
        self._write_status(state, {(a, m, int(k)): gen for a, m, k in runs})
        return started

    def fail(self, runs: Sequence[Run], error: BaseException, started: str | None = None) -> None:
        """Mark runs failed and keep what they stored. Never hides the first error."""
        try:
            state = self._state(runs, "failed", f"{type(error).__name__}: {error}", started)
            self._write_status(self._with_counts(state, runs), self._generations(runs, committed=False))
        except Exception:  # noqa: BLE001
            pass

    def finalize(
        self,
        runs: Sequence[Run],
        calendar: Calendar,
        meta: DataFrame | Mapping[Run, Mapping] | None = None,
        started: str | None = None,
    ) -> None:
        """Store the metadata, check what was stored by reading it back, then commit.

        A run needs folds of both halves. Readers see the new generation from the moment
        its row of the journal is there.
        """
        if meta is None or not isinstance(meta, DataFrame):
            meta = {r: dict((meta or {}).get(r, {})) for r in runs}
        self.write_meta(meta)
        # Stored, as the check below and the journal want them.
        counted = stored(self._with_counts(self._state(runs, "complete", None, started), runs))
        for split, name in (("oos", "n_folds_oos"), ("in_sample", "n_folds_insample")):
            bare = counted.filter(F.col(name) == 0).orderBy(*RUN_KEYS).first()
            if bare is not None:
                raise StoreError(f"run {tuple(bare[k] for k in RUN_KEYS)} has no folds of split {split!r}")
        rows = self._stored("forecasts", schema.FORECASTS, runs)
        folds = self._stored("folds", schema.FOLDS, runs)
        quality.enforce(
            quality.store_checks(
                rows, folds, cut=calendar.cut, last=calendar.last,
                horizon=calendar.geometry.horizon,
            )
        )
        done = counted.withColumn("finished_at", F.lit(_now()))
        self._write_status(done, self._generations(runs, committed=False))

    # -- contents ------------------------------------------------------------------

    def write_forecasts(
        self, rows: DataFrame, *, boundaries: DataFrame | None = None, horizon: int | None = None
    ) -> None:
        """Store forecast rows; with ``boundaries`` and ``horizon`` only whole folds on
        the calendar are accepted. ``rows`` should be a stored or cheap table then, as
        the check reads it once more."""
        columns = self.spark.createDataFrame([], schema.FORECASTS).columns
        if boundaries is not None and horizon is not None:
            quality.enforce(
                {"writable folds": quality.writable_folds(rows, boundaries, horizon)}
            )
        # A large run is spread over tasks by time.
        spread = F.floor(blocks.grid_position("timestamp", HOUR) / blocks.BLOCK_ROWS)
        self._write(rows.select(*columns), "forecasts", spread)

    def write_folds(self, folds: DataFrame) -> None:
        columns = self.spark.createDataFrame([], schema.FOLDS).columns
        self._write(folds.select(*columns), "folds")

    def write_meta(self, meta: DataFrame | Mapping[Run, Mapping]) -> None:
        """Store the metadata of runs (JSON in column ``meta``, or values per run)."""
        if not isinstance(meta, DataFrame):
            rows = []
            for (asset, model, seed), values in meta.items():
                identity = {"asset": asset, "model": model, "seed": int(seed)}
                wrong = {k: values[k] for k in identity if values.get(k, identity[k]) != identity[k]}
                if wrong:
                    raise StoreError(f"meta says {wrong}, the run is {identity}")
                text = json.dumps({**identity, **values}, sort_keys=True, default=str)
                rows.append((asset, model, int(seed), text))
            meta = self.spark.createDataFrame(rows, schema.META)
        self._write(meta.select(*RUN_KEYS, "meta"), "meta")

    def write_staged(self, rows: DataFrame, name: str) -> DataFrame:
        """Materialise an intermediate table in the store, and return it from there.

        Cuts the lineage in shared storage, so a lost executor costs one read.
        """
        rows.write.mode("overwrite").parquet(f"{self._path('staged')}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self._path('staged')}/{name}")

    def write_config_once(self, payloads: Mapping[str, Mapping]) -> None:
        """Store shared settings; what is stored already must be equal."""
        stored = self.read_config()
        for name, payload in payloads.items():
            text = json.dumps(payload, sort_keys=True, default=str)
            if name not in stored:
                row = self.spark.createDataFrame([(name, text)], schema.CONFIG)
                self._replace(row.coalesce(1), "config", ["name"])
            elif stored[name] != json.loads(text):
                raise StoreError(f"stored setting {name!r} differs from the given one")

    def read_config(self) -> dict[str, dict]:
        rows = self._read("config", schema.CONFIG).collect()
        return {r["name"]: json.loads(r["payload"]) for r in rows}

    # -- reading runs ----------------------------------------------------------------

    def _gate(self, runs: Sequence[Run], allow_incomplete: bool) -> dict[Run, str]:
        """The generations to read: committed ones or, where allowed, open ones."""
        state = self._states(runs)
        for asset, model, seed in runs:
            run = (asset, model, int(seed))
            if run not in state:
                raise StoreError(f"run {run} has no status")
            if not allow_incomplete and state[run].done is None:
                raise StoreError(
                    f"run {run} is {state[run].status!r}, not 'complete';"
                    " allow_incomplete=True reads it anyway"
                )
        return {run: r.open if allow_incomplete else r.done for run, r in state.items()}

    def read_forecasts(self, runs: Sequence[Run], *, committed: bool = False) -> DataFrame:
        """Forecast rows of the runs' open generations, or of their committed ones, under
        the declared schema; a row of no known half is an error."""
        return check_forecasts(self._stored("forecasts", schema.FORECASTS, runs, committed=committed))

    def read_folds(self, runs: Sequence[Run], *, committed: bool = False) -> DataFrame:
        return self._stored("folds", schema.FOLDS, runs, committed=committed)

    def read_meta(
        self, run: Run, *, committed: bool = False, gens: Mapping[Run, str] | None = None
    ) -> dict:
        row = self._stored("meta", schema.META, [run], committed=committed, gens=gens).first()
        if row is None:
            return {}
        meta = json.loads(row["meta"])
        identity = {"asset": run[0], "model": run[1], "seed": int(run[2])}
        echo = {k: meta.get(k) for k in identity}
        if echo != identity:
            raise StoreError(f"meta says {echo}, the run is {identity}")
        return meta

    def load_unit(self, run: Run, *, allow_incomplete: bool = False) -> dict:
        """One run as last committed: ``rows``, ``folds``, ``meta`` and ``status``, whatever
        a later attempt does.

        Under ``allow_incomplete`` the open generation, where what is not stored yet reads
        as empty tables.
        """
        gens = self._gate([run], allow_incomplete)
        told = self._of_runs(self._journal(), [run])
        if not allow_incomplete:
            told = told.filter(F.col("status") == "complete")
        return {
            "rows": check_forecasts(self._stored("forecasts", schema.FORECASTS, [run], gens=gens)),
            "folds": self._stored("folds", schema.FOLDS, [run], gens=gens),
            "meta": self.read_meta(run, gens=gens),
            "status": told.orderBy(F.desc("at")).first().asDict(),
        }

    def load_units(
        self, runs: Sequence[Run], *, allow_incomplete: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """Rows and folds of many runs as last committed, which must share one calendar."""
        if not runs:
            raise StoreError("no runs given")
        gens = self._gate(runs, allow_incomplete)
        folds = self._stored("folds", schema.FOLDS, runs, gens=gens)
        quality.enforce({"calendar identity": quality.calendar_identity(folds)})
        return check_forecasts(self._stored("forecasts", schema.FORECASTS, runs, gens=gens)), folds

    def join_features(self, rows: DataFrame, panel: Panel) -> DataFrame:
        """``join_features`` below, against the stored feature set."""
        frozen = self.read_config().get("feature_set")
        if frozen is None:
            raise StoreError("no feature set is stored to check the features against")
        if panel.feature_cols != frozen["feature_columns"]:
            raise StoreError(
                f"feature columns {panel.feature_cols} differ from the stored"
                f" {frozen['feature_columns']}"
            )
        return join_features(rows, panel)


def _listed(df: DataFrame, name: str, values: Collection) -> DataFrame:
    """Rows whose column is one of a few values; all rows where the values are many."""
    return df.filter(F.col(name).isin(sorted(values))) if len(values) <= LISTED else df


def check_forecasts(rows: DataFrame) -> DataFrame:
    """Fail while reading, not later, on a missing time or an unknown half."""
    bad = F.col("timestamp").isNull() | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    message = F.concat(
        F.lit("stored forecast row without a time or of an unknown half: "),
        F.coalesce(F.col("split"), F.lit("NULL")),
    )
    checked = F.when(bad, F.raise_error(message).cast("timestamp_ntz")).otherwise(F.col("timestamp"))
    return rows.withColumn("timestamp", checked)


def parse_val_active(column: str = "val_active"):
    """Text ``True``/``False`` to boolean; anything else is an error."""
    text = F.col(column).cast("string")
    bad = F.raise_error(F.concat(F.lit("val_active is "), F.coalesce(text, F.lit("NULL"))))
    return (
        F.when(text == "True", F.lit(True))
        .when(text == "False", F.lit(False))
        .otherwise(bad.cast("boolean"))
    )


# -- text form -----------------------------------------------------------------

# Number and time formats of the text form.
TEXT_FLOAT = "%.17g"
TEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss"
TEXT_ROWS = "split string, fold_idx long, timestamp string, step long, forecast string, actual string"
TEXT_FOLDS = (
    "fold_idx long, split string, train_start string, train_end string,"
    " last_train_label_ts string, test_start string, test_end string,"
    " volatility string, val_loss string, val_active string"
)


def _exact_text(c: str):
    # The shortest text that reads back as the same double.
    return F.col(c).cast("string").alias(c)


def rows_as_text(rows: DataFrame) -> DataFrame:
    """Forecast rows in the columns and formats of the text form."""
    return rows.select(
        "split", "fold_idx", F.date_format("timestamp", TEXT_TIME).alias("timestamp"), "step",
        _exact_text("forecast"), _exact_text("actual"),
    )


def folds_as_text(folds: DataFrame) -> DataFrame:
    times = ["train_start", "train_end", "last_train_label_ts", "test_start", "test_end"]
    return folds.select(
        "fold_idx", "split", *[F.date_format(t, TEXT_TIME).alias(t) for t in times],
        _exact_text("volatility"), _exact_text("val_loss"),
        F.initcap(F.col("val_active").cast("string")).alias("val_active"),
    )


def rows_from_text(text: DataFrame) -> DataFrame:
    return check_forecasts(
        text.select(
            "split", "fold_idx", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
            "step", F.col("forecast").cast("double").alias("forecast"),
            F.col("actual").cast("double").alias("actual"),
        )
    )


def folds_from_text(text: DataFrame) -> DataFrame:
    times = ["train_start", "train_end", "last_train_label_ts", "test_start", "test_end"]
    return text.select(
        "fold_idx", "split", *[F.col(t).cast("timestamp_ntz").alias(t) for t in times],
        F.col("volatility").cast("double").alias("volatility"),
        F.col("val_loss").cast("double").alias("val_loss"),
        parse_val_active().alias("val_active"),
    )


# -- operators on stored rows ------------------------------------------------------


def join_features(rows: DataFrame, panel: Panel, *, check: bool = True) -> DataFrame:
    """Left-join features to stored rows on asset and time, many to one.

    Raises when a feature row repeats or a stored row has no features; the
    latter is judged by the first feature column.
    """
    features = panel.df.select(
        F.col(panel.asset).alias("asset"), F.col(panel.time).alias("timestamp"), *panel.feature_cols
    )
    joined = rows.join(features, ["asset", "timestamp"], "left")
    if check:
        quality.enforce(
            {"features repeat": quality.repeated_keys(features, ["asset", "timestamp"])}
        )
        if panel.feature_cols:
            bare = joined.filter(F.col(panel.feature_cols[0]).isNull())
            quality.enforce({"rows without features": bare.select("asset", "timestamp")})
    return joined


def fold_packets(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per fold: forecasts, actuals and times ordered by step, and volatility.

    A fold with rows but no fold entry is an error while reading.
    """
    ids = [*keys, "split", "fold_idx"]
    item = F.struct("step", "forecast", "actual", "timestamp")
    packed = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(item)).alias("_p"))
    known = folds.select(*ids, "volatility", F.lit(True).alias("_known"))
    joined = packed.join(known, ids, "left")
    missing = F.raise_error(
        F.concat(F.lit("no fold entry for fold "), F.col("fold_idx").cast("string"))
    ).cast("double")
    vol = F.when(F.col("_known"), F.col("volatility")).otherwise(missing)
    return joined.select(
        *ids,
        F.col("_p.forecast").alias("forecast"),
        F.col("_p.actual").alias("actual"),
        F.col("_p.timestamp").alias("timestamps"),
        vol.alias("volatility"),
    )


def orphan_folds(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Folds with rows but no fold entry."""
    ids = [*keys, "split", "fold_idx"]
    return rows.select(*ids).distinct().join(folds.select(*ids), ids, "left_anti")
