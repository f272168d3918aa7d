"""Strategies, backtests, metrics, the ledger, joins and data-quality checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barfold.functions import metrics
from barfold.functions.trading import sign_signal, threshold_signal, txn_cost_logret
from barfold.operators import backtest, ledger, quality
from barfold.operators.calendar import Schedule
from barfold.operators.models import RidgeSequence
from barfold.operators.tuning import sample_space
from barfold.plans.context import ModelSpec, run_context
from barfold.plans.produce import produce_forecasts
from barfold.schema import RUN_KEYS
from barfold.sources import store
from barfold.sources.store import ForecastStore
from verification import sql
from verification.base import GEOMETRY, STEADY, exploded, query
from verification.folds_and_models import BACKTEST, METRICS, SEQUENCE, metrics_sql
from verification.folds_and_models import CAL as PLAIN_CAL

BARS = sql.bars(STEADY)
LITE = [BARS, sql.LITE]
CAL = [*LITE, sql.calendar()]
ROWS = [*CAL, sql.FOLD_ROWS]
STORED = [sql.bars(), sql.LITE, sql.calendar(), sql.STORED]
P = """
p AS MATERIALIZED (SELECT asset, time, fold_idx, step, log_return_1 AS prediction, log_return AS label FROM te)"""
PRED = [*ROWS, P]


def _momentum(d):
    panel = d.lite(STEADY)
    schedule = d.calendar(panel).schedule("oos")
    return panel, d.momentum(panel, schedule)


# -- signals and costs -----------------------------------------------------------


@query(
    "sign_signal",
    sql.query(
        *PRED, "q AS (SELECT asset, time, CAST(sign(prediction) AS DOUBLE) AS signal FROM p)",
        sql.out("asset time signal:d", "q"),
    ),
)
def _(d):
    _, rows = _momentum(d)
    return rows.select("asset", "time", sign_signal(F.col("prediction")).alias("signal"))


@query(
    "threshold_signal",
    sql.query(
        *PRED,
        """q AS (SELECT asset, time, CASE WHEN prediction < 0.002 THEN -1.0 WHEN prediction > -0.001 THEN 1.0
             ELSE 0.0 END AS overlapping, CASE WHEN prediction < -0.005 THEN -1.0
             WHEN prediction > 0.01 THEN 1.0 ELSE 0.0 END AS apart FROM p)""",
        sql.out("asset time overlapping:d apart:d", "q"),
    ),
)
def _(d):
    _, rows = _momentum(d)
    p = F.col("prediction")
    return rows.select(
        "asset", "time",
        threshold_signal(-0.001, 0.002)(p).alias("overlapping"),
        threshold_signal(0.01, -0.005)(p).alias("apart"),
    )


@query(
    "strategy_returns",
    sql.query(
        *PRED,
        """q AS (SELECT lite.asset, lite.time, coalesce(sign(prediction), 0.0) * (exp(lite.log_return) - 1)
             AS strategy_return FROM lite LEFT JOIN p ON p.asset = lite.asset AND p.time = lite.time
             WHERE hour(lite.time) <> 3)""",
        sql.out("asset time strategy_return:d", "q"),
    ),
)
def _(d):
    panel, rows = _momentum(d)
    market = panel.df.select(
        "asset", "time",
        F.when(F.hour("time") != 3, F.expm1("log_return")).alias("market_return"),
    )
    return backtest.strategy_returns(rows, market)


@query(
    "txn_cost",
    sql.query(
        *PRED,
        "q AS (SELECT asset, time, ln(1 - 0.01 * abs(prediction * 10)) AS cost FROM p)",
        sql.out("asset time cost:d", "q"),
    ),
)
def _(d):
    _, rows = _momentum(d)
    return rows.select(
        "asset", "time", txn_cost_logret(0.01, F.col("prediction") * 10).alias("cost")
    )


# -- backtest --------------------------------------------------------------------


@query(
    "realized_returns",
    sql.query(
        BARS,
        """q AS (SELECT asset, time, ln(lead(close) OVER (PARTITION BY asset ORDER BY time) / close)
             AS actual FROM bars)""",
        sql.out("asset time actual:d", "q"),
    ),
)
def _(d):
    return backtest.realized_returns(d.bars(STEADY))


OVERLAP = """
o AS (SELECT CAST(u.k AS BIGINT) AS fold_idx, t0 + to_hours(168 + 16 * u.k) AS ts0 FROM cal,
        unnest(range(0, 20)) AS u(k)),
op AS (SELECT lite.asset, lite.time, fold_idx, log_return_1 * (1 + fold_idx) AS prediction
       FROM lite JOIN o ON lite.time >= ts0 AND lite.time < ts0 + to_hours(24))"""


@query(
    "finalize_predictions",
    sql.query(
        *CAL, OVERLAP,
        """q AS (SELECT asset, time, max(fold_idx) AS fold_idx, arg_max(prediction, fold_idx) AS prediction
             FROM op GROUP BY 1, 2)""",
        sql.out("asset time fold_idx prediction:d", "q"),
    ),
)
def _(d):
    panel = d.lite(STEADY)
    schedule = Schedule(d.calendar(panel).first, 168, 24, 16, 20)
    rows = d.momentum(panel, schedule).withColumn(
        "prediction", F.col("prediction") * (1 + F.col("fold_idx"))
    )
    return backtest.finalize_predictions(
        rows.select("asset", "time", "fold_idx", "prediction")
    )


BT = "asset time predicted:d actual:d signal:d prev_signal:d gross_log_return:d txn_cost:d net_log_return:d"


@query("backtest", sql.query(*PRED, BACKTEST, sql.out(BT, "bt")))
def _(d):
    panel, rows = _momentum(d)
    return backtest.backtest(rows, panel, reach=1)


SPARSE_P = """
p AS MATERIALIZED (SELECT asset, time, fold_idx, log_return_1 AS prediction FROM lite JOIN sparse
     ON time >= test_start AND time < test_end)"""


@query("backtest_with_gaps", sql.query(*CAL, SPARSE_P, BACKTEST, sql.out(BT, "bt")))
def _(d):
    """Predictions of sparse folds: the previous signal is days away."""
    panel = d.lite(STEADY)
    rows = d.momentum(panel, d.calendar(panel).schedule("in_sample"))
    return backtest.backtest(rows, panel, reach=None)


@query(
    "equity_curve",
    sql.query(
        *PRED, BACKTEST,
        """q AS (SELECT asset, time, CASE WHEN net_log_return IS NOT NULL THEN exp(sum(net_log_return)
             OVER (PARTITION BY asset ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END
             AS equity FROM bt)""",
        sql.out("asset time equity:d", "q"),
    ),
)
def _(d):
    panel, rows = _momentum(d)
    done = backtest.backtest(rows, panel, reach=1)
    return backtest.equity_curve(done, ["asset"]).select("asset", "time", "equity")


@query(
    "simple_returns",
    sql.query(
        *PRED, BACKTEST,
        """q AS (SELECT asset, time, exp(net_log_return) - 1 AS strategy_return,
             exp(actual) - 1 AS market_return FROM bt)""",
        sql.out("asset time strategy_return:d market_return:d", "q"),
    ),
)
def _(d):
    panel, rows = _momentum(d)
    done = backtest.simple_returns(backtest.backtest(rows, panel, reach=1))
    return done.select("asset", "time", "strategy_return", "market_return")


@query(
    "backtest_metrics",
    sql.query(
        *PRED, BACKTEST, "rt AS (SELECT *, exp(net_log_return) - 1 AS sr FROM bt)",
        metrics_sql("rt", "sr", "time", factor=8760), sql.out(METRICS, "mt"),
    ),
)
def _(d):
    panel, rows = _momentum(d)
    done = backtest.backtest(rows, panel, reach=1)
    return backtest.backtest_metrics(done, ["asset"], annual_factor=8760)


# -- metrics on market returns of all bars ------------------------------------------

MARKET = """
mr AS (SELECT asset, time, i, exp(log_return) - 1 AS r FROM lite)"""


def _market(d):
    panel = d.lite(STEADY)
    hours = F.unix_seconds(F.col("time").cast("timestamp")) / 3600
    return panel.df.select(
        "asset", hours.cast("long").alias("i"), F.expm1("log_return").alias("r")
    )


for _metric in metrics.METRICS:

    @query(
        f"metric_{_metric}",
        sql.query(
            *LITE, MARKET, metrics_sql("mr", "r", "time", factor=365),
            sql.out(f"asset {_metric}:d", "mt"),
        ),
    )
    def _(d, name=_metric):
        one = {"sharpe_ratio": metrics.sharpe}.get(name) or getattr(metrics, name)
        return one(_market(d), ["asset"], "r", "i")


@query(
    "compute_all_blocks",
    sql.query(
        *LITE, MARKET, metrics_sql("mr", "r", "time", factor=252), sql.out(METRICS, "mt"),
    ),
)
def _(d):
    """All metrics with blocks of 50 rows, so that carries cross many blocks."""
    return metrics.compute_all(
        _market(d), ["asset"], "r", "i", annual_factor=252, block_rows=50
    )


@query(
    "max_drawdown_exact",
    sql.query(
        *LITE,
        """mr AS (SELECT asset, time, i, 12 * (exp(log_return) - 1) AS r FROM lite),
        me AS (SELECT *, product(1 + r) OVER (PARTITION BY asset ORDER BY time
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM mr),
        mp AS (SELECT *, max(eq) OVER (PARTITION BY asset ORDER BY time
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM me),
        q AS (SELECT asset, min((eq - peak) / peak) AS max_drawdown FROM mp GROUP BY 1)""",
        sql.out("asset max_drawdown:d", "q"),
    ),
)
def _(d):
    """Leveraged returns that lose more than everything."""
    panel = d.lite(STEADY)
    hours = F.unix_seconds(F.col("time").cast("timestamp")) / 3600
    rows = panel.df.select(
        "asset", hours.cast("long").alias("i"), (12 * F.expm1("log_return")).alias("r")
    )
    return metrics.max_drawdown(rows, ["asset"], "r", "i", exact=True, block_rows=10)


# -- ledger -----------------------------------------------------------------------

ACTIONS = """
ac AS (SELECT asset, time, fold_idx, step, (fold_idx * 7 + step * step + hour(time)) % 3 AS action,
         log_return AS actual, log_return_1 AS forecast FROM te),
po AS (SELECT *, CAST(action - 1 AS DOUBLE) AS position FROM ac),
lp AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY asset ORDER BY fold_idx, step), 0.0) AS prev_position FROM po),
ld AS MATERIALIZED (SELECT *, ln(1 - 0.002 * abs(position - prev_position)) AS txn_cost,
         position * actual + ln(1 - 0.002 * abs(position - prev_position)) AS step_pnl FROM lp),
cu AS MATERIALIZED (SELECT *, sum(step_pnl) OVER (PARTITION BY asset, fold_idx ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl FROM ld)"""
LEDGER = [*ROWS, ACTIONS]


def _actions(d):
    panel, rows = _momentum(d)
    action = (F.col("fold_idx") * 7 + F.col("step") * F.col("step") + F.hour("time")) % 3
    return panel, rows.withColumn("action", action).withColumnRenamed("prediction", "forecast")


def _ledger(d):
    panel, actions = _actions(d)
    return panel, actions, ledger.replay_positions(actions, horizon=24, reach=1)


LEDGER_COLUMNS = "asset fold_idx step:i position:d prev_position:d txn_cost:d step_pnl:d"
LEDGER_NAMES = ["asset", "fold_idx", "step", "position", "prev_position", "txn_cost", "step_pnl"]


@query("replay_positions", sql.query(*LEDGER, sql.out(LEDGER_COLUMNS, "ld")))
def _(d):
    return _ledger(d)[2].select(*LEDGER_NAMES)


@query(
    "replay_positions_no_carry",
    sql.query(
        *ROWS,
        ACTIONS.replace("PARTITION BY asset ORDER BY fold_idx, step", "PARTITION BY asset, fold_idx ORDER BY step"),
        sql.out(LEDGER_COLUMNS, "ld"),
    ),
)
def _(d):
    _, actions = _actions(d)
    done = ledger.replay_positions(actions, horizon=24, carry_position=False)
    return done.select(*LEDGER_NAMES)


@query("episode_cum_pnl", sql.query(*LEDGER, sql.out("asset fold_idx step:i cum_pnl:d", "cu")))
def _(d):
    return ledger.episode_cum_pnl(_ledger(d)[2]).select("asset", "fold_idx", "step", "cum_pnl")


ACCURACY = """
ma AS (SELECT asset, fold_idx, avg(abs(log_return_1 - log_return)) AS mae FROM te GROUP BY 1, 2),
fa AS (SELECT asset, fold_idx, coalesce(avg(mae) OVER (PARTITION BY asset ORDER BY fold_idx
         ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0) AS forecast_accuracy FROM ma)"""


@query(
    "forecast_accuracy",
    sql.query(*ROWS, ACCURACY, sql.out("asset fold_idx forecast_accuracy:d", "fa")),
)
def _(d):
    _, actions = _actions(d)
    return ledger.forecast_accuracy(actions)


VOLATILITY = """
fr AS (SELECT asset, fold_idx, ln(close / lag(close) OVER (PARTITION BY asset, fold_idx ORDER BY time)) AS r FROM tr),
fv AS (SELECT asset, fold_idx, coalesce(stddev_pop(r), 0.0) AS volatility FROM fr GROUP BY 1, 2)"""


@query("fold_volatility", sql.query(*ROWS, VOLATILITY, sql.out("asset fold_idx volatility:d", "fv")))
def _(d):
    panel = d.lite(STEADY)
    return ledger.fold_volatility(panel, d.calendar(panel).schedule("oos"))


STATES = """
ob AS (SELECT cu.asset, cu.fold_idx, cu.step, action, step_pnl, prev_position, position, cum_pnl,
         coalesce(lag(cum_pnl) OVER (PARTITION BY cu.asset, cu.fold_idx ORDER BY cu.step), 0.0) AS prior_pnl,
         forecast_accuracy, volatility
       FROM cu JOIN fa ON fa.asset = cu.asset AND fa.fold_idx = cu.fold_idx
       JOIN fv ON fv.asset = cu.asset AND fv.fold_idx = cu.fold_idx),
ex AS (SELECT ob.asset, ob.fold_idx, ob.step, s.part, te.step AS k, log_return_1 AS value
       FROM ob JOIN te ON te.asset = ob.asset AND te.fold_idx = ob.fold_idx,
         (SELECT unnest(['next_state', 'state']) AS part) s
       UNION ALL
       SELECT asset, fold_idx, step, 'state', 24 + u.k, CASE u.k WHEN 0 THEN prev_position
         WHEN 1 THEN prior_pnl WHEN 2 THEN (24 - step) / 24.0 WHEN 3 THEN forecast_accuracy ELSE volatility END
       FROM ob, unnest(range(0, 5)) AS u(k)
       UNION ALL
       SELECT asset, fold_idx, step, 'next_state', 24 + u.k, CASE u.k WHEN 0 THEN position
         WHEN 1 THEN cum_pnl WHEN 2 THEN (23 - step) / 24.0 WHEN 3 THEN forecast_accuracy ELSE volatility END
       FROM ob, unnest(range(0, 5)) AS u(k))"""
OBSERVED = [*LEDGER, ACCURACY, VOLATILITY, STATES]


def _observed(d):
    panel, actions, replayed = _ledger(d)
    schedule = d.calendar(panel).schedule("oos")
    item = F.struct("step", "forecast")
    context = (
        actions.groupBy("asset", "fold_idx")
        .agg(F.array_sort(F.collect_list(item)).alias("_f"))
        .select("asset", "fold_idx", F.col("_f.forecast").alias("forecast"))
        .join(ledger.forecast_accuracy(actions), ["asset", "fold_idx"])
        .join(ledger.fold_volatility(panel, schedule), ["asset", "fold_idx"])
    )
    return ledger.observations(replayed.drop("forecast"), context, horizon=24)


@query("observations", sql.query(*OBSERVED, sql.out("asset fold_idx step:i part k:i value:d", "ex")))
def _(d):
    return exploded(
        _observed(d), ["asset", "fold_idx", "step"],
        state=F.col("state"), next_state=F.col("next_state"),
    )


@query(
    "transitions",
    sql.query(
        *OBSERVED,
        """q AS (SELECT asset, fold_idx, step, action, step_pnl AS reward, step = 23 AS done,
             29 AS state_size FROM ob)""",
        sql.out("asset fold_idx step:i action:i reward:d done state_size:i", "q"),
    ),
)
def _(d):
    moved = ledger.transitions(_observed(d), horizon=24)
    return moved.withColumn("state_size", F.size("next_state")).drop("state", "next_state")


@query(
    "ledger_equity",
    sql.query(
        *LEDGER,
        """q AS (SELECT asset, fold_idx, step, exp(step_pnl) - 1 AS strategy_return, exp(sum(step_pnl)
             OVER (PARTITION BY asset ORDER BY fold_idx, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
             AS equity FROM ld)""",
        sql.out("asset fold_idx step:i strategy_return:d equity:d", "q"),
    ),
)
def _(d):
    done = ledger.ledger_equity(_ledger(d)[2], horizon=24)
    return done.select("asset", "fold_idx", "step", "strategy_return", "equity")


@query(
    "ledger_summary",
    sql.query(
        *LEDGER, "rt AS (SELECT *, exp(step_pnl) - 1 AS sr, fold_idx * 24 + step AS n FROM ld)",
        metrics_sql("rt", "sr", "n"), sql.out(METRICS, "mt"),
    ),
)
def _(d):
    return ledger.ledger_summary(_ledger(d)[2], horizon=24)


# -- joins ------------------------------------------------------------------------


@query(
    "anchor_predictions",
    sql.query(*PRED, sql.out("asset time prediction:d label:d", "p").replace(
        "round(label, 6) + 0.0 AS label", "round(label, 6) + 0.0 AS actual")),
)
def _(d):
    panel, rows = _momentum(d)
    return backtest.anchor_predictions(rows.select("asset", "time", "prediction"), panel)


@query(
    "join_features",
    sql.query(
        *STORED,
        """q AS (SELECT r.asset, r.timestamp, r.split, forecast, log_return_1, log_volume FROM rows_ r
             LEFT JOIN lite ON lite.asset = r.asset AND lite.time = r.timestamp)""",
        sql.out("asset timestamp split forecast:d log_return_1:d log_volume:d", "q"),
    ),
)
def _(d):
    panel, _, rows, _ = d.stored()
    joined = store.join_features(rows, panel)
    return joined.select("asset", "timestamp", "split", "forecast", "log_return_1", "log_volume")


@query(
    "fold_packets",
    sql.query(
        *STORED,
        """q AS (SELECT asset, split, fold_idx, 'forecast' AS part, step AS k, forecast AS value FROM rows_
             UNION ALL SELECT asset, split, fold_idx, 'actual', step, actual FROM rows_)""",
        sql.out("asset split fold_idx part k:i value:d", "q"),
    ),
)
def _(d):
    _, _, rows, folds = d.stored()
    packets = store.fold_packets(rows, folds.withColumn("volatility", F.lit(0.5)))
    return exploded(
        packets, ["asset", "split", "fold_idx"], forecast=F.col("forecast"), actual=F.col("actual")
    )


# -- checks: each query plants violations and lists what its check finds -------------


@query(
    "dq_split_agrees",
    sql.query(*STORED, "SELECT asset, split, timestamp FROM rows_ WHERE split = 'oos' AND step = 5"),
)
def _(d):
    rows = d.stored()[2].withColumn(
        "partition_split", F.when(F.col("step") == 5, "in_sample").otherwise(F.col("split"))
    )
    return quality.split_agrees(rows).select("asset", "split", "timestamp")


@query(
    "dq_unique_timestamps",
    sql.query(
        *STORED,
        sql.out("asset split timestamp n:i", "(SELECT *, 2 AS n FROM rows_ WHERE fold_idx = 2 AND step < 3)"),
    ),
)
def _(d):
    rows = d.stored()[2]
    twice = rows.unionByName(rows.filter((F.col("fold_idx") == 2) & (F.col("step") < 3)))
    return quality.unique_timestamps(twice).select("asset", "split", "timestamp", "n")


@query(
    "dq_contiguous",
    sql.query(
        *STORED,
        """k AS (SELECT * FROM rows_ WHERE NOT (hour(timestamp) = 5 AND day(timestamp) % 4 = 0)),
        z AS (SELECT asset, split, lag(timestamp) OVER w AS before, timestamp AS after FROM k
              WINDOW w AS (PARTITION BY asset, split ORDER BY timestamp)),
        q AS (SELECT *, CAST(date_diff('hour', before, after) AS DOUBLE) AS steps FROM z
              WHERE before IS NOT NULL AND date_diff('hour', before, after) <> 1)""",
        sql.out("asset split before after steps:d", "q"),
    ),
)
def _(d):
    rows = d.stored()[2].filter(~((F.hour("timestamp") == 5) & (F.dayofmonth("timestamp") % 4 == 0)))
    return quality.contiguous(rows, block_rows=30).drop("model", "seed")


@query(
    "dq_oos_tiling",
    sql.query(
        *STORED,
        """k AS (SELECT * FROM rows_ WHERE split = 'oos' AND NOT (asset LIKE 'click%' AND fold_idx = 0 AND step = 0)
             AND NOT (asset LIKE 'view%' AND fold_idx = 3)),
        s AS (SELECT asset, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS n_rows FROM k GROUP BY 1),
        q AS (SELECT s.* FROM s, cal WHERE first_ts <> cut OR last_ts <> t1 OR n_rows % 24 <> 0)""",
        sql.out("asset first_ts last_ts n_rows:i", "q"),
    ),
)
def _(d):
    _, c, rows, _ = d.stored()
    broken = rows.filter(
        ~(F.col("asset").startswith("click") & (F.col("fold_idx") == 0) & (F.col("step") == 0))
        & ~(F.col("asset").startswith("view") & (F.col("fold_idx") == 3))
    )
    return quality.oos_tiling(broken, c.cut, c.last, 24).drop("model", "seed")


@query(
    "dq_insample_coverage",
    sql.query(
        *STORED,
        """k AS (SELECT * FROM rows_ WHERE split = 'in_sample' AND NOT (asset LIKE 'error%' AND fold_idx = 6 AND step > 20)),
        s AS (SELECT asset, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS n_rows FROM k GROUP BY 1),
        q AS (SELECT s.* FROM s, cal WHERE last_ts <> cut - to_hours(1) OR n_rows % 24 <> 0)""",
        sql.out("asset first_ts last_ts n_rows:i", "q"),
    ),
)
def _(d):
    _, c, rows, _ = d.stored()
    last = F.col("asset").startswith("error") & (F.col("fold_idx") == 6) & (F.col("step") > 20)
    kept = rows.filter(~(last & (F.col("split") == "in_sample")))
    return quality.insample_coverage(kept, c.cut, 24).drop("model", "seed")


@query(
    "dq_halves_disjoint",
    sql.query(
        *STORED,
        """k AS (SELECT asset, split, timestamp FROM rows_ UNION ALL
             SELECT asset, 'in_sample', timestamp FROM rows_ WHERE split = 'oos' AND fold_idx = 1 AND asset LIKE 'sign%'),
        s AS (SELECT asset, max(timestamp) FILTER (split = 'in_sample') AS last_in_sample,
                min(timestamp) FILTER (split = 'oos') AS first_oos FROM k GROUP BY 1),
        b2 AS (SELECT asset, count(*) AS n_shared FROM (SELECT asset, timestamp FROM k GROUP BY 1, 2
                HAVING count(DISTINCT split) = 2) GROUP BY 1),
        q AS (SELECT s.*, coalesce(n_shared, 0) AS n_shared FROM s LEFT JOIN b2 ON b2.asset = s.asset, cal
              WHERE NOT (last_in_sample < cut AND first_oos >= cut) OR n_shared > 0)""",
        sql.out("asset last_in_sample first_oos n_shared:i", "q"),
    ),
)
def _(d):
    _, c, rows, _ = d.stored()
    wrong = rows.filter(
        (F.col("split") == "oos") & (F.col("fold_idx") == 1) & F.col("asset").startswith("sign")
    ).withColumn("split", F.lit("in_sample"))
    return quality.halves_disjoint(rows.unionByName(wrong), c.cut).drop("model", "seed")


@query(
    "dq_embargo",
    sql.query(
        *STORED,
        """k AS (SELECT *, last_train_label_ts + to_hours(fold_idx) AS late FROM folds_),
        q AS (SELECT asset, split, fold_idx, date_diff('hour', late, test_start) AS gap FROM k
              WHERE date_diff('hour', late, test_start) < 24)""",
        sql.out("asset split fold_idx gap:i", "q"),
    ),
)
def _(d):
    folds = d.stored()[3].withColumn(
        "last_train_label_ts",
        F.col("last_train_label_ts") + F.make_dt_interval(hours=F.col("fold_idx").cast("int")),
    )
    return quality.embargo(folds, 24).select("asset", "split", "fold_idx", "gap")


@query(
    "dq_dual_key_folds",
    sql.query(
        *STORED,
        """r AS (SELECT DISTINCT asset, split, fold_idx FROM rows_ WHERE fold_idx <> 3),
        f2 AS (SELECT asset, split, fold_idx FROM folds_ WHERE fold_idx <> 5),
        q AS (SELECT *, 'folds' AS missing_in FROM (SELECT * FROM r EXCEPT SELECT * FROM f2)
              UNION ALL SELECT *, 'rows' FROM (SELECT * FROM f2 EXCEPT SELECT * FROM r))""",
        "SELECT * FROM q",
    ),
)
def _(d):
    _, _, rows, folds = d.stored()
    found = quality.dual_key_folds(
        rows.filter(F.col("fold_idx") != 3), folds.filter(F.col("fold_idx") != 5)
    )
    return found.drop("model", "seed")


@query(
    "dq_dual_key_steps",
    sql.query(
        *STORED,
        """k AS (SELECT asset, split, fold_idx, CASE WHEN fold_idx = 4 AND step = 7 THEN 99 ELSE step END AS step
             FROM rows_ WHERE NOT (fold_idx = 1 AND step = 23)),
        q AS (SELECT asset, split, fold_idx, count(*) AS n_rows, count(DISTINCT step) AS n_steps,
              min(step) AS first_step, max(step) AS last_step FROM k GROUP BY 1, 2, 3
              HAVING n_rows <> 24 OR n_steps <> 24 OR first_step <> 0 OR last_step <> 23)""",
        sql.out("asset split fold_idx n_rows:i n_steps:i first_step:i last_step:i", "q"),
    ),
)
def _(d):
    rows = d.stored()[2].filter(~((F.col("fold_idx") == 1) & (F.col("step") == 23)))
    odd = (F.col("fold_idx") == 4) & (F.col("step") == 7)
    changed = rows.withColumn("step", F.when(odd, F.lit(99)).otherwise(F.col("step")))
    return quality.dual_key_steps(changed, 24).drop("model", "seed")


@query(
    "dq_dual_key_times",
    sql.query(
        *STORED,
        """q AS (SELECT asset, split, fold_idx, step, timestamp + to_hours(1) AS timestamp, timestamp AS expected
             FROM rows_ WHERE fold_idx = 2)""",
        sql.out("asset split fold_idx step:i timestamp expected", "q"),
    ),
)
def _(d):
    _, _, rows, folds = d.stored()
    late = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    shifted = rows.withColumn(
        "timestamp", F.when(F.col("fold_idx") == 2, late).otherwise(F.col("timestamp"))
    )
    return quality.dual_key_times(shifted, folds).drop("model", "seed")


@query(
    "dq_unique_folds",
    sql.query(
        *STORED,
        sql.out("asset fold_idx split n:i", "(SELECT *, 2 AS n FROM folds_ WHERE split = 'oos' AND fold_idx = 3)"),
    ),
)
def _(d):
    folds = d.stored()[3]
    again = folds.filter((F.col("split") == "oos") & (F.col("fold_idx") == 3))
    return quality.unique_folds(folds.unionByName(again)).drop("model", "seed")


@query(
    "dq_writable_folds",
    sql.query(
        *STORED,
        """q AS (SELECT asset, split, fold_idx, count(*) FILTER (NOT (fold_idx = 2 AND step = 0)) AS n_rows,
             NOT (split = 'oos' AND fold_idx = 4) AS scheduled FROM rows_ GROUP BY 1, 2, 3)""",
        sql.out(
            "asset split fold_idx n_rows:i scheduled", "q WHERE n_rows <> 24 OR NOT scheduled"
        ),
    ),
)
def _(d):
    _, _, rows, folds = d.stored()
    kept = rows.filter(~((F.col("fold_idx") == 2) & (F.col("step") == 0)))
    edges = folds.select("split", "fold_idx").distinct().filter(
        ~((F.col("split") == "oos") & (F.col("fold_idx") == 4))
    )
    return quality.writable_folds(kept, edges, 24).drop("model", "seed")


HOLES = """
hb AS (SELECT * FROM bars WHERE NOT (asset LIKE 'view%' AND hour(time) = 7 AND day(time) IN (3, 9))
        AND NOT (asset LIKE 'click%' AND day(time) BETWEEN 11 AND 12)),
hz AS (SELECT asset, lag(time) OVER (PARTITION BY asset ORDER BY time) AS before, time AS after FROM hb),
q AS (SELECT asset, count(*) AS n_holes, min(before) AS first_before, arg_min(after, before) AS first_after
      FROM hz WHERE date_diff('hour', before, after) <> 1 GROUP BY 1)"""


def _holed(d):
    view = F.col("asset").startswith("view") & (F.hour("time") == 7) & F.dayofmonth("time").isin(3, 9)
    click = F.col("asset").startswith("click") & F.dayofmonth("time").between(11, 12)
    panel = d.bars()
    return type(panel)(panel.df.filter(~view & ~click))


@query(
    "dq_hourly_grid",
    sql.query(sql.bars(), HOLES, sql.out("asset n_holes:i first_before first_after", "q")),
)
def _(d):
    return quality.hourly_grid(_holed(d), block_rows=50)


@query(
    "dq_grid_shape",
    sql.query(
        sql.bars(), HOLES,
        """s2 AS (SELECT asset, count(*) AS n_points, count(*) AS n_rows, 0 AS n_off_grid,
             date_diff('hour', min(time), max(time)) + 1 AS n_expected FROM hb GROUP BY 1)""",
        sql.out("asset n_points:i n_rows:i n_off_grid:i n_expected:i", "s2 WHERE n_points <> n_expected"),
    ),
)
def _(d):
    return quality.grid_shape(_holed(d))


@query(
    "dq_assets_agree",
    sql.query(
        sql.bars(),
        """hb AS (SELECT * FROM bars WHERE NOT (asset LIKE 'view%' AND day(time) = 1)),
        s2 AS (SELECT asset, min(time) AS first_usable_ts, max(time) AS last_usable_ts, count(*) AS n_usable_rows
               FROM hb GROUP BY 1),
        ref AS (SELECT first_usable_ts AS f, last_usable_ts AS l, n_usable_rows AS n FROM s2 ORDER BY asset LIMIT 1)""",
        sql.out(
            "asset first_usable_ts last_usable_ts n_usable_rows:i",
            "s2, ref WHERE first_usable_ts <> f OR last_usable_ts <> l OR n_usable_rows <> n",
        ),
    ),
)
def _(d):
    panel = d.bars()
    late = ~(F.col("asset").startswith("view") & (F.dayofmonth("time") == 1))
    return quality.assets_agree(type(panel)(panel.df.filter(late)))


@query(
    "dq_asset_precondition",
    sql.query(
        sql.bars(),
        """s2 AS (SELECT asset, min(time) AS first_usable_ts, max(time) AS last_usable_ts, count(*) AS n_usable_rows
               FROM bars WHERE asset = 'view-0' AND day(time) > 1 GROUP BY 1)""",
        sql.out("asset first_usable_ts last_usable_ts n_usable_rows:i", "s2"),
    ),
)
def _(d):
    panel = d.bars()
    reference = quality.asset_summary(panel).orderBy("asset").first().asDict()
    late = type(panel)(panel.df.filter(F.dayofmonth("time") > 1))
    return quality.asset_precondition(late, "view-0", reference)


@query(
    "dq_calendar_identity",
    sql.query(
        *STORED,
        """n0 AS (SELECT count(DISTINCT asset) AS n FROM folds_),
        k AS (SELECT asset, split, fold_idx, train_start, train_end, test_start,
              CASE WHEN asset LIKE 'view%' AND fold_idx = 1 THEN test_end + to_hours(1) ELSE test_end END AS test_end
              FROM folds_ WHERE NOT (asset LIKE 'click-0' AND fold_idx = 2)),
        q AS (SELECT split, fold_idx, count(DISTINCT (train_start, train_end, test_start, test_end)) AS n_versions,
              count(DISTINCT asset) AS n_runs FROM k GROUP BY 1, 2)""",
        sql.out(
            "split fold_idx n_versions:i n_runs:i",
            "q, n0 WHERE n_versions <> 1 OR n_runs <> n",
        ),
    ),
)
def _(d):
    folds = d.stored()[3].filter(~((F.col("asset") == "click-0") & (F.col("fold_idx") == 2)))
    late = F.col("asset").startswith("view") & (F.col("fold_idx") == 1)
    shifted = folds.withColumn(
        "test_end",
        F.when(late, F.col("test_end") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("test_end")),
    )
    return quality.calendar_identity(shifted)


@query(
    "dq_store_checks",
    sql.query(
        *STORED,
        """q AS (SELECT asset, count(*) AS n_rows, count(*) FILTER (fold_idx = 1 AND step = 2) AS n_violations
             FROM rows_ GROUP BY 1)""",
        sql.out("asset n_rows:i n_violations:i", "q"),
    ),
)
def _(d):
    """All checks of a finished run at once. Times repeated in rows of sound folds are
    found once each by the check for them, and by no other but the fold sizes."""
    _, c, rows, folds = d.stored()
    twice = rows.filter((F.col("fold_idx") == 1) & (F.col("step") == 2))
    found = quality.store_checks(
        rows.unionByName(twice), folds, cut=c.cut, last=c.last, horizon=24
    )
    found = [v.select("asset") for name, v in found.items() if name in (
        "split agrees", "unique timestamps", "halves disjoint", "unique folds", "embargo",
        "dual key: folds", "dual key: times")]
    bad = found[0]
    for part in found[1:]:
        bad = bad.unionAll(part)
    count = F.count(F.lit(1))
    sizes = rows.groupBy("asset").agg(count.alias("n_rows"))
    counted = bad.groupBy("asset").agg(count.alias("n_violations"))
    return sizes.join(counted, "asset", "left").withColumn(
        "n_violations", F.coalesce("n_violations", F.lit(0))
    )


# -- store and producer --------------------------------------------------------------


@query(
    "load_units",
    sql.query(
        *STORED,
        """m AS (SELECT unnest(['momentum', 'reversal']) AS model),
        q AS (SELECT r.asset, m.model, r.split, r.fold_idx, r.timestamp, r.step,
              CASE WHEN m.model = 'momentum' THEN forecast ELSE -forecast END AS forecast, actual FROM rows_ r, m)""",
        sql.out("asset model split fold_idx timestamp step:i forecast:d actual:d", "q"),
    ),
)
def _(d):
    """Two models written to a store, checked, completed and read back together."""
    panel, c, rows, folds = d.stored()
    kept = ForecastStore(d.spark, d.scratch() + "/store")
    flipped = rows.withColumns({"model": F.lit("reversal"), "forecast": -F.col("forecast")})
    both = rows.unionByName(flipped)
    facts = {"volatility": F.lit(0.5), "val_loss": F.lit(None).cast("double"), "val_active": F.lit(False)}
    fold_rows = folds.withColumns(facts)
    runs = [tuple(r) for r in both.select(*RUN_KEYS).distinct().collect()]
    kept.begin(runs)
    kept.write_forecasts(both)
    kept.write_folds(fold_rows.unionByName(fold_rows.withColumn("model", F.lit("reversal"))))
    kept.finalize(runs, c)
    return kept.load_units(runs)[0].drop("seed")


@query(
    "store_text_round_trip",
    sql.query(*STORED, sql.out("split fold_idx timestamp step:i forecast:d actual:d", "rows_")),
)
def _(d):
    return store.rows_from_text(store.rows_as_text(d.stored()[2]))


@query("produce_forecasts")
def _(d):
    """The whole producer: context, search, dense and out-of-sample passes, store, checks."""
    models = {"ridge_sequence": ModelSpec(RidgeSequence(), lookback=12)}
    ctx = run_context(d.bars(), GEOMETRY, models, n_trials=2, longest_lookback=48)
    kept = ForecastStore(d.spark, d.scratch() + "/store")
    return kept.load_units(produce_forecasts(d.spark, ctx, kept))[0]


TRIALS = 3
ALPHAS = [c["alpha"] for c in sample_space(ModelSpec(RidgeSequence()).search_space, TRIALS, 0)]
_ONCE, _BY_ALPHA = "f0 raw sc z inner_ sw tw pw".split(), "nm wt pr vl".split()


def _produced_sql() -> list[str]:
    """Losses of every penalty on the sparse folds, the best one of each asset, its forecasts of both halves."""

    def named(text: str, half: str, n: int | None = None) -> str:
        text = re.sub(rf"\b({'|'.join(_ONCE)})\b", rf"\1_{half}", text)
        return text if n is None else re.sub(rf"\b({'|'.join(_BY_ALPHA)})\b", rf"\1_{half}{n}", text)

    main, normal, loss = SEQUENCE[len(PLAIN_CAL):]
    ctes = [*PLAIN_CAL]
    for half in ("sparse", "dense", "oos"):
        ctes.append(named(main.replace("{folds}", "@"), half).replace("@", half))
        for n, alpha in enumerate(ALPHAS):
            ctes.append(named(normal.replace("+ 1.0", f"+ {alpha!r}"), half, n))
            if half == "sparse":
                ctes.append(named(loss, half, n))
    numbers = range(len(ALPHAS))
    losses = " UNION ALL ".join(f"SELECT asset, {n} AS trial, avg(val_loss) AS score FROM vl_sparse{n} GROUP BY 1" for n in numbers)
    made = " UNION ALL ".join(
        f"SELECT '{split}' AS split, {n} AS trial, asset, fold_idx, step, prediction FROM pr_{half}{n}"
        for split, half in (("in_sample", "dense"), ("oos", "oos")) for n in numbers
    )
    return [
        *ctes,
        f"""ls AS ({losses}),
        bs AS (SELECT asset, arg_min(trial, score) AS trial FROM ls GROUP BY 1),
        pa AS ({made}),
        hv AS (SELECT 'oos' AS split, fold_idx, test_start FROM oos UNION ALL SELECT 'in_sample', fold_idx, test_start FROM dense),
        q AS (SELECT pa.asset, 'ridge' AS model, 0 AS seed, pa.split, pa.fold_idx, l.time AS timestamp, step,
              prediction AS forecast, l.log_return AS actual
            FROM pa JOIN bs ON bs.asset = pa.asset AND bs.trial = pa.trial
            JOIN hv ON hv.split = pa.split AND hv.fold_idx = pa.fold_idx
            JOIN lite l ON l.asset = pa.asset AND l.time = hv.test_start + to_hours(step))""",
    ]


@query(
    "produce_forecasts_two_inputs",
    sql.query(
        *_produced_sql(),
        sql.out("asset model seed:i split fold_idx timestamp step:i forecast:d actual:d", "q"),
    ),
)
def _(d):
    """The whole producer on one feature and two steps back, where SQL can search, fit and forecast, too."""
    models = {"ridge": ModelSpec(RidgeSequence(), lookback=2)}
    config = [{"name": "LOG_RETURN_1"}, {"name": "LOG_RETURN"}]
    ctx = run_context(d.bars(), GEOMETRY, models, n_trials=TRIALS, longest_lookback=48, config=config, val_ratio=0.3)
    kept = ForecastStore(d.spark, d.scratch() + "/store")
    return kept.load_units(produce_forecasts(d.spark, ctx, kept))[0]
