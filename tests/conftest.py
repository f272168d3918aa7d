import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barfold.panel import Panel
from barfold.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


START = dt.datetime(2024, 1, 1)


def bar_frame(assets=("a", "b"), rows=400, seed=0):
    """Random-walk bars; one asset may be asked for with another length."""
    rng, parts = np.random.default_rng(seed), []
    for n, asset in enumerate(assets):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, rows)))
        parts.append(
            pd.DataFrame(
                {
                    "asset": asset,
                    "time": pd.date_range(START, periods=rows, freq="h"),
                    "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
                    "volume": rng.integers(1, 50, rows).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    types = {"asset": "string", "time": "timestamp_ntz", "fold_idx": "long", "step": "long",
             "timestamp": "timestamp_ntz", "i": "long"}
    ddl = ", ".join(f"{c} {types.get(c, 'double')}" for c in pdf.columns)
    rows = [
        tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v)
              for v in r)
        for r in pdf.astype(object).itertuples(index=False)
    ]
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def bars(spark):
    pdf = bar_frame()
    df = to_spark(spark, pdf).cache()
    return pdf, Panel(df).on_grid()
