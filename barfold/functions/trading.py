"""Column expressions for signals, costs and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Strategy = Callable[[Column], Column]

# Fixed value: cost of a position change of one unit.
TXN_COST = 0.002


def sign_signal(prediction: Column) -> Column:
    """+1, 0 or -1."""
    return F.signum(prediction)


def threshold_signal(upper: float = 0.0, lower: float = 0.0) -> Strategy:
    """+1 above ``upper``, -1 below ``lower``, else 0; below wins where both hold."""

    def signal(prediction: Column) -> Column:
        return (
            F.when(prediction < F.lit(lower), F.lit(-1.0))
            .when(prediction > F.lit(upper), F.lit(1.0))
            .otherwise(F.lit(0.0))
        )

    return signal


def txn_cost_logret(cost: float, position_change: Column) -> Column:
    """Cost of a position change as a log return: ``ln(1 - cost*|change|)``."""
    return F.ln(F.lit(1.0) - F.lit(cost) * F.abs(position_change))


def action_position(action: Column) -> Column:
    """Actions 0, 1, 2 are the positions -1, 0, 1."""
    bad = F.raise_error(F.concat(F.lit("unknown action "), action.cast("string")))
    return F.when(action.isin(0, 1, 2), action - 1).otherwise(bad.cast("int")).cast("double")
