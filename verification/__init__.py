"""Queries over the test tables, each beside equivalent DuckDB SQL where SQL can say it."""

from verification import bars_and_features, folds_and_models, trading_and_quality  # noqa: F401
from verification.base import ORACLES, QUERIES  # noqa: F401
