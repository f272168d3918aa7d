"""Registry of queries and the panels they start from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.functions.features import DEFAULT_CONFIG, apply_features
from barfold.operators import folds
from barfold.operators.calendar import Calendar, Geometry, calendar_of
from barfold.panel import Panel
from barfold.session import checkpoint_root, use_utc
from barfold.sources.events import hourly_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GEOMETRY = Geometry(train=168, test=24, horizon=24, in_sample_step=48, oos_step=24)
LITE_CONFIG = [{"name": "LOG_RETURN_1"}, {"name": "LOG_VOLUME"}, {"name": "LOG_RETURN"}]
# Price offset under which returns stay small.
STEADY = 1000.0


def query(name: str, sql: str | None = None):
    """Register a query; its double columns are rounded for comparison."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Data(use_utc(spark), sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


class Data:
    """Input tables of one scale, and what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    @property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def bars(self, offset: float = 1.0) -> Panel:
        return hourly_bars(self.events, price_offset=offset)

    def features(self, config=DEFAULT_CONFIG, **options) -> Panel:
        return apply_features(self.bars(), config, **options)

    def lite(self, offset: float = 1.0) -> Panel:
        """Return, log volume and label. Volume is never 0, so the grid stays whole.

        Written once and read back: calendar, folds, fits and returns all start here.
        """
        panel = apply_features(self.bars(offset), LITE_CONFIG).on_grid()
        path = self.scratch() + "/lite"
        panel.df.write.parquet(path)
        return replace(panel, df=self.spark.read.schema(panel.df.schema).parquet(path))

    def calendar(self, panel: Panel) -> Calendar:
        return calendar_of(panel, GEOMETRY, longest_lookback=48)

    def lite_fold_rows(self, name: str = "oos"):
        panel = self.lite()
        schedule = self.calendar(panel).schedule(name)
        return panel, schedule, folds.assign_folds(panel, schedule)

    def momentum(self, panel: Panel, schedule) -> DataFrame:
        """Forecast of every test row: its last return."""
        tests = folds.assign_folds(panel, schedule, (folds.TEST,))
        start = schedule.fold_of(F.col("fold_idx"))["train_to"]
        return tests.select(
            "asset", "time", "fold_idx", (F.col("_pos") - start).alias("step"),
            F.col("log_return_1").alias("prediction"), F.col("log_return").alias("actual"),
        )

    def stored(self) -> tuple[Panel, Calendar, DataFrame, DataFrame]:
        """Momentum forecasts of both halves as stored rows, and their fold table."""
        panel = self.lite()
        calendar = self.calendar(panel)
        rows, fold_table = [], []
        run = {"model": F.lit("momentum"), "seed": F.lit(0).cast("long")}
        for split, name in (("oos", "oos"), ("in_sample", "in_sample_dense")):
            schedule = calendar.schedule(name)
            rows.append(
                self.momentum(panel, schedule)
                .withColumnsRenamed({"time": "timestamp", "prediction": "forecast"})
                .withColumns(run | {"split": F.lit(split)})
            )
            last = folds.last_train_label(panel, schedule, GEOMETRY.horizon)
            fold_table.append(
                last.join(schedule.boundaries(self.spark), "fold_idx").withColumns(
                    run | {"split": F.lit(split)}
                )
            )
        return panel, calendar, rows[0].unionByName(rows[1]), fold_table[0].unionByName(fold_table[1])

    def scratch(self) -> str:
        """A new folder under the shared one."""
        return f"{checkpoint_root(self.spark)}/barfold-{uuid.uuid4().hex}"


def exploded(df: DataFrame, keys: list[str], **arrays: Column) -> DataFrame:
    """Arrays as rows ``(*keys, part, k, value)``."""
    parts = [
        df.select(*keys, F.lit(name).alias("part"), F.posexplode(value).alias("k", "value"))
        for name, value in arrays.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("k", F.col("k").cast("long"))
