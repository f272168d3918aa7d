"""Declared schemas of input files and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of a raw kline file, by position, and the header words
# that may appear as a data row inside such files.
KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore",
]
KLINE_HEADER = "open_time"
FUNDING_COLUMNS = ["calc_time", "interval", "rate"]
FUNDING_HEADER = "calc_time"


def all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Stored tables, as DDL.

# The two halves of a run.
SPLITS = ("in_sample", "oos")
RUN_KEYS = ["asset", "model", "seed"]

FORECASTS = (
    "asset string, model string, seed long, split string, fold_idx long,"
    " timestamp timestamp_ntz, step long, forecast double, actual double"
)
FOLDS = (
    "asset string, model string, seed long, fold_idx long, split string,"
    " train_start timestamp_ntz, train_end timestamp_ntz,"
    " last_train_label_ts timestamp_ntz, test_start timestamp_ntz,"
    " test_end timestamp_ntz, volatility double, val_loss double, val_active boolean"
)
BOUNDARIES = (
    "fold_idx long, train_start timestamp_ntz, train_end timestamp_ntz,"
    " test_start timestamp_ntz, test_end timestamp_ntz"
)
STATUS = (
    "asset string, model string, seed long, status string, started_at string,"
    " finished_at string, error string, n_folds_oos long, n_folds_insample long,"
    " n_rows_oos long, n_rows_insample long, gen string, at long"
)
WRITES = (
    "table string, asset string, model string, seed long, split string, gen string,"
    " write string"
)
META = "asset string, model string, seed long, meta string"
CONFIG = "name string, payload string"
BOUNDARY_COLUMNS = ["fold_idx", "split", "train_start", "train_end", "test_start", "test_end"]
