"""Hourly bars out of a table of timed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.operators import blocks
from barfold.panel import HOUR, Panel
from barfold.session import require_utc

COHORT_USERS = 50
#: About so many hours of series are laid out by one task.
TASK_ROWS = 1 << 17


def event_asset(cohort_users: int | None = COHORT_USERS) -> Column:
    """Series name of an event: its type, and its user cohort unless ``None``."""
    if cohort_users is None:
        return F.col("event_type")
    cohort = blocks.floor_div(F.col("user_id"), cohort_users)
    return F.concat_ws("-", F.col("event_type"), cohort.cast("string"))


def _order() -> Column:
    """Time, then event id, as one number: ties in time stay deterministic, and a
    fixed-width key keeps first/last on the hash aggregate."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return micros.cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(
        "event_id"
    ).cast("decimal(19,0)")


def ticks(
    events: DataFrame, cohort_users: int | None = COHORT_USERS, *, price_offset: float = 1.0
) -> Panel:
    """Every event as one row of its series: not on a grid, one row per event."""
    df = events.select(
        event_asset(cohort_users).alias("asset"),
        F.col("ts").alias("time"),
        (F.col("value") + F.lit(price_offset)).alias("close"),
        F.lit(1.0).alias("volume"),
    )
    return Panel(df, ohlcv={"close": "close", "volume": "volume"})


def hourly_bars(
    events: DataFrame, cohort_users: int | None = COHORT_USERS, *, price_offset: float = 1.0
) -> Panel:
    """Gap-free hourly OHLCV bars of all series over the hours the events span.

    Empty hours repeat the last close; hours before the first event of a series
    take its first open. Volume is the event count plus one.
    """
    require_utc(events.sparkSession)
    rows = events.select(
        event_asset(cohort_users).alias("asset"),
        blocks.floor_time(F.col("ts"), "hour").alias("time"),
        _order().alias("order"),
        (F.col("value") + F.lit(price_offset)).alias("price"),
    )
    bars = rows.groupBy("asset", "time").agg(
        F.min_by("price", "order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "order").alias("close"),
        F.count(F.lit(1)).alias("n"),
    )
    # One row: the hours every series has to cover, and about how many series there are.
    hour = blocks.grid_position("ts", HOUR)
    first, last, n_series = events.agg(
        F.min(hour), F.max(hour), F.approx_count_distinct(event_asset(cohort_users))
    ).first()
    if first is None:
        return Panel(
            bars.select("asset", "time", "open", "high", "low", "close",
                        (F.col("n") + 1.0).alias("volume"))
        ).on_grid(HOUR)
    # The table of series is tiny beside their hours: left to its own size it would be
    # one partition, and a single task would lay out and order the bars of all series.
    tasks = max(1, -(-n_series * (last - first + 1) // TASK_ROWS))
    if tasks == int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        tasks += 1  # Spark would take the aggregate's partitions instead, and merge them
    grid = (
        rows.groupBy("asset")
        .agg(F.min_by("price", "order").alias("first_open"))
        .repartition(tasks, "asset")
        .withColumn(blocks.POS, F.explode(F.sequence(F.lit(first), F.lit(last))))
        .withColumn("time", blocks.grid_time(blocks.POS, HOUR))
    )
    joined = grid.join(bars, ["asset", "time"], "left")
    filled = blocks.running(joined, ["asset"], {"last_close": ("last", "close")})
    flat = F.coalesce(F.col("last_close"), F.col("first_open"))
    out = filled.select(
        "asset",
        "time",
        F.coalesce("open", flat).alias("open"),
        F.coalesce("high", flat).alias("high"),
        F.coalesce("low", flat).alias("low"),
        F.coalesce("close", flat).alias("close"),
        (F.coalesce("n", F.lit(0)) + 1.0).alias("volume"),
    )
    return Panel(out).on_grid(HOUR)
