"""Sources, container operations and transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from barfold.functions.features import (
    add_lagged_returns,
    apply_features,
    lagged_return_array,
    register,
)
from barfold.panel import Panel, normalize_time
from barfold.sources import bars as bar_files
from barfold.sources.events import ticks
from verification import sql
from verification.base import DEFAULT_CONFIG, exploded, query

BARS = sql.bars()
START, END = datetime(2024, 1, 5), datetime(2024, 1, 12)
BETWEEN = "TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'"

# -- sources --------------------------------------------------------------------


@query(
    "hourly_bars",
    sql.query(BARS, sql.out("asset time open:d high:d low:d close:d volume:d", "bars")),
)
def _(d):
    return d.bars().df


@query(
    "read_bars",
    sql.query(BARS, sql.out("asset time close:d", "bars")),
)
def _(d):
    path = d.scratch() + "/csv"
    bar_files.export_csv(d.bars().df, path)
    return bar_files.read_bars(d.spark, path, preset="univariate", asset_from="folder").df


@query(
    "read_bars_mixed",
    sql.query(
        BARS,
        """q AS (SELECT asset, time, close, volume,
             CASE WHEN ascii(right(asset, 1)) % 3 = 2 THEN NULL ELSE open END AS open,
             CASE WHEN ascii(right(asset, 1)) % 3 = 2 THEN NULL ELSE high END AS high,
             CASE WHEN ascii(right(asset, 1)) % 3 = 2 THEN NULL ELSE low END AS low FROM bars)""",
        """SELECT asset, time, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low,
             round(close, 6) + 0.0 AS close, CASE WHEN open IS NULL THEN NULL ELSE round(volume, 6) + 0.0 END AS volume FROM q""",
    ),
)
def _(d):
    """Files with other orders, with more columns and with two columns alone, in one read."""
    path = d.scratch() + "/csv"
    iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("open_time_iso")
    bars = d.bars().df.select("asset", iso, "open", "high", "low", "close", "volume")
    kinds = [
        ["open_time_iso", "open", "high", "low", "close", "volume", F.lit("x, y").alias("note")],
        ["volume", "close", "low", "open_time_iso", "high", "open"],
        ["open_time_iso", "close"],
    ]
    for n, columns in enumerate(kinds):
        some = bars.filter(F.ascii(F.right("asset", F.lit(1))) % 3 == n).select("asset", *columns)
        some.write.mode("append").partitionBy("asset").csv(path, header=True)
    return bar_files.read_bars(d.spark, path, preset="tick", asset_from="folder").df.select(
        "asset", "time", "open", "high", "low", "close", "volume"
    )


@query(
    "write_bars",
    sql.query(BARS, sql.out("asset time open:d high:d low:d close:d volume:d", "bars")),
)
def _(d):
    path = d.scratch() + "/bars"
    bar_files.write_bars(d.bars().df, path)
    return bar_files.read_bar_table(d.spark, path).df


def _raw_klines(d):
    """Kline rows as text: an old file in milliseconds with every even hour, and a newer
    one in microseconds, with a header row, with every hour and other closes."""
    bars = d.bars().df
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "volume")]
    micros = F.unix_micros(F.col("time").cast("timestamp"))

    def rows(file, epoch, close):
        return bars.select(
            "asset", "time", F.lit(file).alias("file_name"), epoch.cast("string").alias("open_time"),
            *text, close.cast("string").alias("close"),
        )

    old = rows("a.csv", micros / 1000, F.col("close")).withColumn(
        "open_time", (micros / 1000).cast("long").cast("string")
    ).filter(F.hour("time") % 2 == 0)
    new = rows("b.csv", micros, F.col("close") + 1.0)
    header = bars.groupBy("asset").agg(F.max("time").alias("time")).select(
        "asset", "time", F.lit("b.csv").alias("file_name"),
        *[F.lit(c).alias(c) for c in ("open_time", "open", "high", "low", "volume", "close")],
    )
    return old.unionByName(new).unionByName(header).drop("time")


@query(
    "normalize_klines",
    sql.query(
        BARS,
        """q AS (SELECT asset, time, open, high, low,
          CASE WHEN hour(time) % 2 = 0 THEN close ELSE close + 1.0 END AS close, volume FROM bars)""",
        sql.out("asset time open:d high:d low:d close:d volume:d", "q"),
    ),
)
def _(d):
    return bar_files.normalize_klines(_raw_klines(d), order=("file_name",))


@query(
    "epoch_to_ts",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE ts END AS time
       FROM events""",
)
def _(d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    epoch = F.when(F.col("event_id") % 2 == 0, F.expr("unix_millis(CAST(ts AS TIMESTAMP))"))
    return d.events.select(
        "event_id", bar_files.epoch_to_ts(F.coalesce(epoch, micros)).alias("time")
    )


def _funding(d):
    raw = d.events.select(
        F.col("event_type").alias("asset"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("calc_time"),
        F.lit("8").alias("interval"),
        F.col("value").cast("string").alias("rate"),
    )
    header = d.events.select(F.col("event_type").alias("asset")).distinct().select(
        "asset", F.lit("calc_time").alias("calc_time"), F.lit("i").alias("interval"),
        F.lit("rate").alias("rate"),
    )
    return bar_files.normalize_funding(raw.unionByName(header))


FUNDING = """
f AS (SELECT event_type AS asset, date_trunc('hour', ts) AS time, arg_max(value, ts) AS funding_rate
      FROM events GROUP BY 1, 2)"""


@query("normalize_funding", sql.query(FUNDING, sql.out("asset time funding_rate:d", "f")))
def _(d):
    return _funding(d)


@query(
    "attach_funding",
    sql.query(
        BARS, FUNDING,
        f"""q AS (SELECT strftime(bars.time, '%Y-%m-%dT%H:%M:%S+00:00') AS open_time_iso, bars.asset,
          bars.time, open, high, low, close, volume, coalesce(funding_rate, 0.0) AS funding_rate
          FROM bars LEFT JOIN f ON f.asset = split_part(bars.asset, '-', 1) AND f.time = bars.time
          WHERE bars.time BETWEEN {BETWEEN})""",
        sql.out(
            "open_time_iso asset time open:d high:d low:d close:d volume:d funding_rate:d", "q"
        ),
    ),
)
def _(d):
    bars = d.bars().df
    types = bars.select("asset").distinct().withColumn("kind", F.split("asset", "-")[0])
    rates = _funding(d).withColumnRenamed("asset", "kind").join(types, "kind").drop("kind")
    return bar_files.attach_funding(bars, rates, START, END)


# -- container ---------------------------------------------------------------------


@query(
    "select_features",
    sql.query(BARS, sql.LITE, sql.out("asset time log_return_1:d log_volume:d", "lite")),
)
def _(d):
    return d.lite().select_features()


@query("select_labels", sql.query(BARS, sql.LITE, sql.out("asset time log_return:d", "lite")))
def _(d):
    return d.lite().select_labels()


@query(
    "select_columns",
    sql.query(BARS, sql.out("asset time close:d volume:d", "bars")),
)
def _(d):
    return d.bars().select_columns(["close", "volume"])


EXTRA = """
x AS (SELECT asset, t AS time, CAST(n AS DOUBLE) AS n_events FROM b)"""


@query(
    "add_features",
    sql.query(
        BARS, EXTRA,
        """q AS (SELECT bars.asset, bars.time, close, n_events FROM bars LEFT JOIN x
             ON x.asset = bars.asset AND x.time = bars.time)""",
        sql.out("asset time close:d n_events:d", "q"),
    ),
)
def _(d):
    counts = ticks(d.events).df.groupBy(
        "asset", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")
    ).agg(F.count(F.lit(1)).cast("double").alias("n_events"))
    panel = d.bars().add_features(counts)
    assert panel.feature_cols == ["n_events"]
    return panel.select_columns(["close", "n_events"])


@query(
    "add_labels_and_remove",
    sql.query(
        BARS,
        "q AS (SELECT asset, time, close, high - low AS spread FROM bars)",
        sql.out("asset time close:d spread:d", "q"),
    ),
)
def _(d):
    panel = d.bars().add_labels({"spread": F.col("high") - F.col("low"), "mid": F.lit(1.0)})
    panel = panel.remove_labels(["mid", "absent"]).remove_features(["open", "absent"])
    return panel.select_columns(["close", "spread"])


@query(
    "drop_incomplete",
    sql.query(
        BARS,
        "q AS (SELECT bars.asset, bars.time, close FROM bars JOIN b ON b.asset = bars.asset AND b.t = bars.time)",
        sql.out("asset time close:d", "q"),
    ),
)
def _(d):
    seen = ticks(d.events).df.groupBy(
        "asset", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")
    ).agg(F.max("close").alias("top"))
    return d.bars().add_features(seen).drop_incomplete().select_columns(["close"])


@query(
    "slice_time",
    sql.query(
        BARS,
        """q AS (SELECT * FROM bars WHERE time >= TIMESTAMP '2024-01-05 00:00:00'
             AND time < TIMESTAMP '2024-01-12 00:00:00')""",
        sql.out("asset time close:d", "q"),
    ),
)
def _(d):
    return d.bars().slice_time(START, END).select_columns(["close"])


@query(
    "clip_inclusive",
    sql.query(
        BARS, f"q AS (SELECT * FROM bars WHERE time BETWEEN {BETWEEN})",
        sql.out("asset time close:d", "q"),
    ),
)
def _(d):
    return d.bars().clip_inclusive(START, END).select_columns(["close"])


@query(
    "slice_index",
    sql.query(BARS, "q AS (SELECT * FROM bars WHERE i >= 10 AND i < 200)",
              sql.out("asset time close:d", "q")),
)
def _(d):
    return d.bars().slice_index(10, 200).select_columns(["close"])


TICKS = """
t AS (SELECT event_type || '-' || CAST(user_id // 50 AS VARCHAR) AS asset, ts AS time, value + 1.0 AS close,
        row_number() OVER (PARTITION BY event_type || '-' || CAST(user_id // 50 AS VARCHAR)
          ORDER BY ts) - 1 AS i FROM events)"""


@query(
    "slice_index_off_grid",
    sql.query(TICKS, "q AS (SELECT * FROM t WHERE i >= 5 AND i < 400)",
              sql.out("asset time close:d", "q")),
)
def _(d):
    return ticks(d.events).slice_index(5, 400).select_columns(["close"])


@query(
    "normalize_time",
    """SELECT event_id, date_trunc('second', ts) AS time FROM events""",
)
def _(d):
    local = F.date_format(
        F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"
    )
    text = d.events.select("event_id", local.alias("open_time_iso"))
    return normalize_time(text).select("event_id", "time")


# -- transforms ------------------------------------------------------------------

ONE_FEATURE = {
    "log_return_1": {"name": "LOG_RETURN_1"},
    "ewm_volatility": {"name": "EWM_VOLATILITY", "span": 72},
    "vol_scaled_return": {"name": "VOL_SCALED_RETURN", "span": 72},
    "rsi": {"name": "RSI", "period": 14},
    "macd_norm": {"name": "MACD_NORM", "fast": 12, "slow": 26, "norm_period": 72},
    "log_volume": {"name": "LOG_VOLUME"},
    "log_return": {"name": "LOG_RETURN", "horizon": 1},
}


def _one_feature(column: str, spec: dict):
    ctes = [BARS, sql.FEATURES]
    if column in ("log_return_1", "log_volume", "log_return"):
        ctes = [BARS, sql.LITE.split(",\nlite AS")[0].replace("lite0 AS", "feat AS")]

    @query(f"feature_{column}", sql.query(*ctes, sql.out(f"asset time {column}:d", "feat")))
    def _(d):
        return d.features([spec], drop_incomplete=False).select_columns([column])


for _column, _spec in ONE_FEATURE.items():
    _one_feature(_column, _spec)


@query(
    "simple_return_label",
    sql.query(
        BARS,
        """q AS (SELECT asset, time, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS simple_return
             FROM bars WINDOW w AS (PARTITION BY asset ORDER BY time))""",
        sql.out("asset time simple_return:d", "q"),
    ),
)
def _(d):
    spec = [{"name": "simple_return", "shift": -2}]
    return d.features(spec, drop_incomplete=False).select_labels()


LAGS = """
r0 AS (SELECT asset, time, close, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY time)) AS r FROM bars),
q AS (SELECT asset, time, close, lag(r, 1) OVER w AS log_return_lag_1, lag(r, 2) OVER w AS log_return_lag_2,
        lag(r, 3) OVER w AS log_return_lag_3 FROM r0 WINDOW w AS (PARTITION BY asset ORDER BY time))"""
LAG_COLUMNS = "asset time log_return_lag_1:d log_return_lag_2:d log_return_lag_3:d"


@query("lagged_returns", sql.query(BARS, LAGS, sql.out(LAG_COLUMNS, "q")))
def _(d):
    spec = [{"name": "lagged_returns", "lags": 3}]
    return d.features(spec, drop_incomplete=False).select_features()


@query(
    "add_lagged_returns",
    sql.query(BARS, LAGS, sql.out(LAG_COLUMNS, "q WHERE log_return_lag_3 IS NOT NULL")),
)
def _(d):
    return add_lagged_returns(d.bars(), 3).select_features()


@query(
    "lagged_return_array",
    sql.query(
        BARS, LAGS,
        """u AS (SELECT asset, time, 'lag' AS part, k, CASE k WHEN 0 THEN log_return_lag_1
             WHEN 1 THEN log_return_lag_2 ELSE log_return_lag_3 END AS value
             FROM q, unnest(range(0, 3)) AS n(k) WHERE log_return_lag_3 IS NOT NULL)""",
        sql.out("asset time part k:i value:d", "u"),
    ),
)
def _(d):
    panel = lagged_return_array(d.bars(), 3)
    return exploded(panel.df, ["asset", "time"], lag=F.col("log_return_lags"))


ALL_FEATURES = (
    "asset time log_return_1:d vol_scaled_return:d ewm_volatility:d rsi:d macd_norm:d"
    " log_volume:d log_return:d"
)


@query(
    "apply_features",
    sql.query(
        BARS, sql.FEATURES,
        sql.out(ALL_FEATURES, "feat WHERE i >= 72 AND log_return IS NOT NULL"),
    ),
)
def _(d):
    panel = d.features(DEFAULT_CONFIG)
    return panel.select_columns([*panel.feature_cols, *panel.label_cols])


@register("BAR_RANGE", before=2)
def _bar_range(frame, rows: int = 3, **_):
    full = frame.rows.rowsBetween(1 - rows, 0)
    return {"bar_range": F.max("high").over(full) - F.min("low").over(full)}


@query(
    "registered_transform",
    sql.query(
        BARS,
        """q AS (SELECT asset, time, max(high) OVER w - min(low) OVER w AS bar_range FROM bars
             WINDOW w AS (PARTITION BY asset ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
        sql.out("asset time bar_range:d", "q"),
    ),
)
def _(d):
    return d.features([{"name": "bar_range", "rows": 3}]).select_features()


@query(
    "tick_features",
    sql.query(
        TICKS.replace("t AS", "t AS MATERIALIZED"),
        """s AS MATERIALIZED (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY i)) AS r FROM t),
        sm AS (SELECT asset, i, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS m2 FROM s WHERE i = 0
          UNION ALL SELECT s.asset, s.i,
            CASE WHEN m IS NULL THEN s.r ELSE m + (s.r - m) * 2.0 / 25.0 END,
            CASE WHEN m2 IS NULL THEN s.r * s.r ELSE m2 + (s.r * s.r - m2) * 2.0 / 25.0 END
          FROM sm JOIN s ON s.asset = sm.asset AND s.i = sm.i + 1),
        q AS (SELECT s.asset, s.time, s.r AS log_return_1,
          sqrt(greatest(m2 - m * m, 0) / (1 - (pow(23.0 / 25.0, 2 * (s.i - 1)) + pow(2.0 / 25.0, 2)
            * (1 - pow(23.0 / 25.0, 2 * (s.i - 1))) / (1 - pow(23.0 / 25.0, 2))))) AS ewm_volatility
          FROM s JOIN sm ON s.asset = sm.asset AND s.i = sm.i WHERE s.i >= 24)""",
        sql.out("asset time log_return_1:d ewm_volatility:d", "q"),
    ),
)
def _(d):
    """Series with one row per event: positions come from counting, not from time."""
    config = [{"name": "LOG_RETURN_1"}, {"name": "EWM_VOLATILITY", "span": 24}]
    return apply_features(ticks(d.events), config).select_features()
