"""Calendar, folds, samples, scaling, fits and tuning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barfold.functions.features import add_lagged_returns, apply_features
from barfold.operators import calendar as cal
from barfold.operators import folds, samples, scaling, tuning, walkforward
from barfold.operators.models import EstimatorForecaster, RidgeDMS, RidgeSequence
from barfold.operators.scaling import FoldScaler
from barfold.plans.research import forecast_and_backtest
from verification import sql
from verification.base import LITE_CONFIG, STEADY, exploded, query

BARS = sql.bars()
LITE = [BARS, sql.LITE]
CAL = [*LITE, sql.calendar()]
ROWS = [*CAL, sql.FOLD_ROWS]
EDGES = "fold_idx train_start train_end test_start test_end"


# -- calendar ---------------------------------------------------------------------


def _splits_sql(mode: str) -> str:
    start = "t0" if mode == "expanding" else "t0 + to_hours(36 * u.k)"
    return f"""
sp2 AS (SELECT min(time) AS t0, max(time) AS t1 FROM lite),
q AS (SELECT CAST(u.k AS BIGINT) AS fold_idx, {start} AS train_start,
        t0 + to_hours(36 * u.k + 240) AS train_end, t0 + to_hours(36 * u.k + 240) AS test_start,
        t0 + to_hours(36 * u.k + 264) AS test_end
      FROM sp2, unnest(range(0, 1000)) AS u(k) WHERE t0 + to_hours(36 * u.k + 264) <= t1)"""


def _splits(d, mode):
    return cal.splits_of(d.lite(), train="10d", test="24h", step=36, mode=mode)


@query("splits_sliding", sql.query(*LITE, _splits_sql("sliding"), sql.out(EDGES, "q")))
def _(d):
    return _splits(d, "sliding").boundaries(d.spark)


@query("splits_expanding", sql.query(*LITE, _splits_sql("expanding"), sql.out(EDGES, "q")))
def _(d):
    return _splits(d, "expanding").boundaries(d.spark)


HOLED = """
h AS (SELECT * FROM lite WHERE day(time) NOT BETWEEN 12 AND 14 OR asset NOT LIKE 'view%'),
hf AS (SELECT h.asset, f.fold_idx,
         count(*) FILTER (h.time >= f.train_start AND h.time < f.train_end) AS n_train,
         count(*) FILTER (h.time >= f.test_start AND h.time < f.test_end) AS n_test
       FROM h, q f GROUP BY 1, 2)"""


@query(
    "nonempty_folds",
    sql.query(
        *LITE, _splits_sql("sliding"), HOLED,
        sql.out("asset fold_idx n_train:i n_test:i", "hf WHERE n_train > 0 AND n_test > 0"),
    ),
)
def _(d):
    panel = d.lite()
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36)
    holed = panel.df.filter(
        ~F.dayofmonth("time").between(12, 14) | ~F.col("asset").startswith("view")
    )
    return folds.nonempty_folds(type(panel)(holed), schedule)


@query(
    "split_summary",
    sql.query(
        *LITE, _splits_sql("sliding"),
        """z AS (SELECT 'sliding' AS mode, 240 AS train_window, 24 AS test_window, 36 AS step,
             '3600 seconds' AS unit, strftime(t0, '%Y-%m-%dT%H:%M:%S') AS start,
             strftime(t1, '%Y-%m-%dT%H:%M:%S') AS "end", (SELECT count(*) FROM q) AS n_splits FROM sp2)""",
        'SELECT * FROM z',
    ),
)
def _(d):
    panel = d.lite()
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36)
    per_asset = folds.nonempty_folds(panel, schedule).select("fold_idx").distinct()
    return cal.split_summary(schedule, per_asset, cal.span_of(panel)[1])


@query(
    "assign_folds",
    sql.query(
        *LITE, _splits_sql("sliding"),
        """a AS (SELECT asset, time, fold_idx, CASE WHEN time < train_end THEN 'train' ELSE 'test' END AS role
             FROM lite JOIN q ON time >= train_start AND time < test_end)""",
        "SELECT * FROM a",
    ),
)
def _(d):
    panel = d.lite()
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36)
    return folds.assign_folds(panel, schedule).select("asset", "time", "fold_idx", "role")


@query(
    "assign_folds_expanding",
    sql.query(
        *LITE, _splits_sql("expanding"),
        """a AS (SELECT asset, fold_idx, count(*) FILTER (time < train_end) AS n_train,
             count(*) FILTER (time >= train_end) AS n_test
             FROM lite JOIN q ON time >= train_start AND time < test_end GROUP BY 1, 2)""",
        sql.out("asset fold_idx n_train:i n_test:i", "a"),
    ),
)
def _(d):
    panel = d.lite()
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36, mode="expanding")
    rows = folds.assign_folds(panel, schedule)
    return rows.groupBy("asset", "fold_idx").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
    )


@query(
    "snap_cut",
    sql.query(
        *CAL,
        """q AS (SELECT t0 AS t_first, t1 AS t_last, n AS n_total_rows, snap AS snap_adjustment_h,
             cut AS t_cut, (SELECT count(*) FROM oos) AS n_oos, (SELECT count(*) FROM dense) AS n_dense,
             (SELECT count(*) FROM sparse) AS n_sparse FROM cal)""",
        sql.out(
            "t_first t_last n_total_rows:i snap_adjustment_h:i t_cut n_oos:i n_dense:i n_sparse:i", "q"
        ),
    ),
)
def _(d):
    c = d.calendar(d.lite())
    row = (c.first, c.last, c.rows, c.snap, c.cut, *[c.folds(n) for n in ("oos", "in_sample_dense", "in_sample")])
    return d.spark.createDataFrame(
        [row],
        "t_first timestamp_ntz, t_last timestamp_ntz, n_total_rows long, snap_adjustment_h long,"
        " t_cut timestamp_ntz, n_oos long, n_dense long, n_sparse long",
    )


for _name, _cte in (("oos", "oos"), ("in_sample_dense", "dense"), ("in_sample", "sparse")):

    @query(f"boundaries_{_name}", sql.query(*CAL, sql.out(EDGES, _cte)))
    def _(d, name=_name):
        return d.calendar(d.lite()).schedule(name).boundaries(d.spark)


@query(
    "bind_calendar",
    sql.query(
        *CAL,
        """a AS (SELECT asset, fold_idx, CASE WHEN time < train_end THEN 'train' ELSE 'test' END AS role,
             count(*) AS n, min(time) AS first_time, max(time) AS last_time
             FROM lite JOIN sparse ON time >= train_start AND time < test_end GROUP BY 1, 2, 3)""",
        sql.out("asset fold_idx role n:i first_time last_time", "a"),
    ),
)
def _(d):
    panel = d.lite()
    rows = folds.bind(panel, d.calendar(panel), "in_sample")
    return rows.groupBy("asset", "fold_idx", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


PROVENANCE = """
pv AS (SELECT strftime(t0, '%Y-%m-%dT%H:%M:%S') AS t_first, strftime(t1, '%Y-%m-%dT%H:%M:%S') AS t_last,
         strftime(cut, '%Y-%m-%dT%H:%M:%S') AS t_cut, n, snap, n_oos,
         (SELECT count(*) FROM oos) AS f_oos, (SELECT count(*) FROM dense) AS f_dense,
         (SELECT count(*) FROM sparse) AS f_sparse FROM cal),
js AS (SELECT 'calendar' AS name, format(
         '{{"L_max": 48, "cut_fraction": 0.5, "geometry": {{"delta_insample_h": 48, "delta_oos_h": 24, "embargo_h": 24, '
         || '"mode": "sliding", "test_window_h": 24, "train_window_h": 168}}, "n_folds": {{"in_sample": {}, '
         || '"in_sample_dense": {}, "oos": {}}}, "n_rows": {{"in_sample_dense": {}, "oos": {}}}, "n_total_rows": {}, '
         || '"snap_adjustment_h": {}, "t_cut": "{}", "t_first": "{}", "t_last": "{}"}}',
         f_sparse, f_dense, f_oos, 24 * f_dense, n_oos, n, snap, t_cut, t_first, t_last) AS payload FROM pv)"""


@query("calendar_provenance", sql.query(*CAL, PROVENANCE, "SELECT name, payload FROM js"))
def _(d):
    return d.calendar(d.lite()).provenance_table(d.spark)


# -- samples -----------------------------------------------------------------------


@query(
    "tabular_samples",
    sql.query(
        *LITE,
        """q AS (SELECT asset, time, 'x' AS part, k, CASE k WHEN 0 THEN log_return_1 ELSE log_volume END AS value
             FROM lite, unnest(range(0, 2)) AS u(k) UNION ALL SELECT asset, time, 'y', 0, log_return FROM lite)""",
        sql.out("asset time part k:i value:d", "q"),
    ),
)
def _(d):
    return exploded(
        samples.tabular(d.lite()), ["asset", "time"], x=F.col("x"), y=F.array("y")
    )


@query(
    "sequence_samples",
    sql.query(
        *LITE,
        """n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS p,
             count(*) OVER (PARTITION BY asset) AS total FROM lite),
        q AS (SELECT a.asset, a.time, 'x' AS part, 2 * u.k + v.f AS k,
               CASE v.f WHEN 0 THEN b.log_return_1 ELSE b.log_volume END AS value
             FROM n a, unnest(range(0, 4)) AS u(k), unnest(range(0, 2)) AS v(f), n b
             WHERE b.asset = a.asset AND b.p = a.p - 4 + u.k AND a.p >= 4 AND a.p + 3 <= a.total
             UNION ALL
             SELECT a.asset, a.time, 'y', u.k, b.log_return FROM n a, unnest(range(0, 3)) AS u(k), n b
             WHERE b.asset = a.asset AND b.p = a.p + u.k AND a.p >= 4 AND a.p + 3 <= a.total)""",
        sql.out("asset time part k:i value:d", "q"),
    ),
)
def _(d):
    made = samples.sequences(d.lite(), 4, 3)
    return exploded(made, ["asset", "time"], x=F.flatten("x"), y=F.flatten("y"))


@query(
    "dms_targets",
    sql.query(
        *LITE,
        """n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS p,
             count(*) OVER (PARTITION BY asset) AS total FROM lite),
        q AS (SELECT a.asset, a.time, 'y' AS part, u.k, b.log_return AS value
             FROM n a, unnest(range(0, 3)) AS u(k), n b
             WHERE b.asset = a.asset AND b.p = a.p + u.k AND a.p < a.total - 3)""",
        sql.out("asset time part k:i value:d", "q"),
    ),
)
def _(d):
    return exploded(samples.dms_targets(d.lite(), 3), ["asset", "time"], y=F.col("y"))


@query("embargo_trim", sql.query(*ROWS, "SELECT asset, time, fold_idx FROM tm"))
def _(d):
    _, schedule, rows = d.lite_fold_rows()
    kept = folds.embargo_trim(rows, schedule, 24).filter(F.col("role") == "train")
    return kept.select("asset", "time", "fold_idx")


@query(
    "embargo_trim_by_rows",
    sql.query(
        *ROWS,
        """h AS (SELECT * FROM tr WHERE hour(time) <> 7),
        k AS (SELECT *, row_number() OVER (PARTITION BY asset, fold_idx ORDER BY time DESC) AS back FROM h)""",
        "SELECT asset, time, fold_idx FROM k WHERE back > 24",
    ),
)
def _(d):
    """The same on series with holes: rows are counted, not hours."""
    _, _, rows = d.lite_fold_rows()
    holed = rows.filter((F.hour("time") != 7) & (F.col("role") == "train"))
    return folds.embargo_trim_rows(holed, "asset", 24).select("asset", "time", "fold_idx")


@query(
    "last_train_label",
    sql.query(
        *ROWS,
        "q AS (SELECT asset, fold_idx, max(time) AS last_train_label_ts FROM tm GROUP BY 1, 2)",
        "SELECT * FROM q",
    ),
)
def _(d):
    panel = d.lite()
    return folds.last_train_label(panel, d.calendar(panel).schedule("oos"), 24)


@query(
    "inner_split",
    sql.query(
        *ROWS,
        """k AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY asset, fold_idx) AS n
             FROM tm WINDOW w AS (PARTITION BY asset, fold_idx ORDER BY time)),
        q AS (SELECT asset, time, fold_idx, CASE WHEN n >= 2 * 36 AND r > n - least(greatest(
               CAST(floor(n * 0.3) AS BIGINT), 36), n - 36) THEN 'val' ELSE 'train' END AS part FROM k)""",
        "SELECT * FROM q",
    ),
)
def _(d):
    _, schedule, rows = d.lite_fold_rows()
    trimmed = folds.embargo_trim(rows, schedule, 24)
    return samples.inner_split(trimmed, "asset", 12, 24, 0.3).select(
        "asset", "time", "fold_idx", "part"
    )


@query(
    "sequence_context",
    sql.query(
        *ROWS,
        """k AS (SELECT *, row_number() OVER (PARTITION BY asset, fold_idx ORDER BY time DESC) AS back FROM tr),
        q AS (SELECT asset, fold_idx, 'x' AS part, 2 * (6 - back) + f AS k,
             CASE f WHEN 0 THEN log_return_1 ELSE log_volume END AS value
             FROM k, unnest(range(0, 2)) AS u(f) WHERE back <= 6)""",
        sql.out("asset fold_idx part k:i value:d", "q"),
    ),
)
def _(d):
    panel = d.lite()
    made = samples.sequence_context(panel, d.calendar(panel).schedule("oos"), 6)
    return exploded(made, ["asset", "fold_idx"], x=F.flatten("x"))


@query(
    "tabular_context",
    sql.query(
        *ROWS,
        """q AS (SELECT asset, fold_idx, time, 'x' AS part, k,
             CASE k WHEN 0 THEN log_return_1 ELSE log_volume END AS value
             FROM te, unnest(range(0, 2)) AS u(k) WHERE step = 0)""",
        sql.out("asset fold_idx time part k:i value:d", "q"),
    ),
)
def _(d):
    panel = d.lite()
    made = samples.tabular_context(panel, d.calendar(panel).schedule("oos"))
    return exploded(made, ["asset", "fold_idx", "time"], x=F.col("x"))


HOLED_ROWS = """
hl AS MATERIALIZED (SELECT * FROM lite WHERE hour(time) % 5 <> 2 AND NOT (asset LIKE 'view%' AND day(time) BETWEEN 17 AND 18))"""


def _holed(d):
    """Every asset lacks hours, and some lack two whole days."""
    panel = d.lite()
    keep = (F.hour("time") % 5 != 2) & ~(F.col("asset").startswith("view") & F.dayofmonth("time").between(17, 18))
    return type(panel)(panel.df.filter(keep), panel.features, panel.labels), d.calendar(panel).schedule("oos")


@query(
    "sequence_context_holes",
    sql.query(
        *CAL, HOLED_ROWS,
        """k AS (SELECT l.*, f.fold_idx, row_number() OVER (PARTITION BY asset, fold_idx ORDER BY time DESC) AS back,
             count(*) OVER (PARTITION BY asset, fold_idx) AS n
             FROM hl l JOIN oos f ON l.time >= f.train_start AND l.time < f.train_end),
        q AS (SELECT asset, fold_idx, 'x' AS part, 2 * (least(n, 30) - back) + f AS k,
             CASE f WHEN 0 THEN log_return_1 ELSE log_volume END AS value
             FROM k, unnest(range(0, 2)) AS u(f) WHERE back <= 30)""",
        sql.out("asset fold_idx part k:i value:d", "q"),
    ),
)
def _(d):
    panel, schedule = _holed(d)
    made = samples.sequence_context(panel, schedule, 30)
    return exploded(made, ["asset", "fold_idx"], x=F.flatten("x"))


@query(
    "tabular_context_holes",
    sql.query(
        *CAL, HOLED_ROWS,
        """f1 AS (SELECT asset, fold_idx, min(time) AS time FROM hl JOIN oos f
             ON time >= f.test_start AND time < f.test_end GROUP BY 1, 2),
        q AS (SELECT f1.asset, f1.fold_idx, f1.time, 'x' AS part, k,
             CASE k WHEN 0 THEN log_return_1 ELSE log_volume END AS value
             FROM f1 JOIN hl ON hl.asset = f1.asset AND hl.time = f1.time, unnest(range(0, 2)) AS u(k))""",
        sql.out("asset fold_idx time part k:i value:d", "q"),
    ),
)
def _(d):
    panel, schedule = _holed(d)
    made = samples.tabular_context(panel, schedule)
    return exploded(made, ["asset", "fold_idx", "time"], x=F.col("x"))


# -- scaling -----------------------------------------------------------------------

COLS = ("log_return_1", "log_volume", "log_return")
CENTER_SCALE = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": (
        "quantile_cont({c}, 0.5)",
        "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
    ),
}


def _stats_sql(method: str, name: str = "st", source: str = "tm") -> str:
    center, scale = CENTER_SCALE[method]
    items = ", ".join(
        f"{center.format(c=c)} AS {c}__center,"
        f" CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END AS {c}__scale"
        for c in COLS
    )
    return f"{name} AS (SELECT asset, fold_idx, {items} FROM {source} GROUP BY asset, fold_idx)"


STAT_COLUMNS = "asset fold_idx " + " ".join(f"{c}__center:d {c}__scale:d" for c in COLS)

for _method in scaling.METHODS:

    @query(
        f"scaler_{_method}", sql.query(*ROWS, _stats_sql(_method), sql.out(STAT_COLUMNS, "st"))
    )
    def _(d, method=_method):
        panel = d.lite()
        return FoldScaler(method).fit(panel, d.calendar(panel).schedule("oos"), 24).stats


for _method in ("standard", "robust"):

    @query(
        f"scaler_{_method}_expanding",
        sql.query(
            *LITE, _splits_sql("expanding"),
            """tm AS (SELECT lite.*, fold_idx FROM lite JOIN q ON time >= train_start
                 AND time < train_end - to_hours(24))""",
            _stats_sql(_method),
            sql.out(STAT_COLUMNS, "st"),
        ),
    )
    def _(d, method=_method):
        panel = d.lite()
        schedule = cal.splits_of(panel, train="10d", test="24h", step=36, mode="expanding")
        return FoldScaler(method).fit(panel, schedule, 24).stats


@query(
    "scaler_transform",
    sql.query(
        *ROWS, _stats_sql("standard"),
        """ar AS (SELECT asset, time, fold_idx, 'train' AS role, log_return_1, log_volume, log_return FROM tr
             UNION ALL SELECT asset, time, fold_idx, 'test', log_return_1, log_volume, log_return FROM te),
        q AS (SELECT ar.asset, time, ar.fold_idx, role, """
        + ", ".join(f"(ar.{c} - {c}__center) / {c}__scale AS {c}" for c in COLS)
        + " FROM ar JOIN st ON st.asset = ar.asset AND st.fold_idx = ar.fold_idx)",
        sql.out("asset time fold_idx role log_return_1:d log_volume:d log_return:d", "q"),
    ),
)
def _(d):
    panel, schedule, rows = d.lite_fold_rows()
    scaled = FoldScaler("standard").fit_transform(panel, schedule, 24, rows)
    return scaled.select("asset", "time", "fold_idx", "role", *COLS)


@query(
    "scaler_inverse_labels",
    sql.query(
        *ROWS, _stats_sql("standard"),
        """q AS (SELECT te.asset, time, te.fold_idx, log_return_1 * log_return__scale + log_return__center AS prediction
             FROM te JOIN st ON st.asset = te.asset AND st.fold_idx = te.fold_idx)""",
        sql.out("asset time fold_idx prediction:d", "q"),
    ),
)
def _(d):
    panel, schedule, _ = d.lite_fold_rows()
    scaler = FoldScaler("standard").fit(panel, schedule, 24)
    scaled = d.momentum(panel, schedule).select("asset", "time", "fold_idx", "prediction")
    return scaler.inverse_labels(scaled, "prediction")


# -- fits --------------------------------------------------------------------------

# Two features, all in scaled units: the normal equations have a closed form.
# ``tw`` are training samples (x1, x2, step, y), ``pw`` the inputs to predict.
NORMAL = """
nm AS (SELECT asset, fold_idx, step, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
         covar_pop(x1, x1) * count(*) + 1.0 AS s11, covar_pop(x2, x2) * count(*) + 1.0 AS s22,
         covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y,
         covar_pop(x2, y) * count(*) AS s2y FROM tw GROUP BY 1, 2, 3),
wt AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM nm),
pr AS (SELECT wt.asset, wt.fold_idx, wt.step,
         (my + w1 * (pw.x1 - m1) + w2 * (pw.x2 - m2)) * pw.sy + pw.cy AS prediction
       FROM wt JOIN pw ON pw.asset = wt.asset AND pw.fold_idx = wt.fold_idx)"""


def _tabular_sql(offset: float) -> list[str]:
    """Ridge on lags 1 and 2, DMS targets, standard scaling, out-of-sample folds."""
    return [
        sql.bars(offset),
        """l0 AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(volume) AS log_volume,
              ln(lead(close) OVER w / close) AS log_return FROM bars
            WINDOW w AS (PARTITION BY asset ORDER BY time)),
        lite AS MATERIALIZED (SELECT *, r AS log_return_1 FROM l0 WHERE r IS NOT NULL AND log_return IS NOT NULL)""",
        sql.calendar(),
        """lg AS MATERIALIZED (SELECT asset, time, lag(r, 1) OVER w AS x1, lag(r, 2) OVER w AS x2, log_return AS y
             FROM lite WINDOW w AS (PARTITION BY asset ORDER BY time)),
        raw AS MATERIALIZED (SELECT lg.asset, lg.time, f.fold_idx, f.train_end, x1, x2, y FROM lg JOIN oos f
             ON lg.time >= f.train_start AND lg.time < f.train_end - to_hours(24)),
        sc AS (SELECT asset, fold_idx, avg(x1) AS c1, stddev_pop(x1) AS d1, avg(x2) AS c2,
             stddev_pop(x2) AS d2, avg(y) AS cy, stddev_pop(y) AS sy FROM raw GROUP BY 1, 2),
        z AS MATERIALIZED (SELECT raw.asset, raw.time, raw.fold_idx, train_end, (x1 - c1) / d1 AS x1, (x2 - c2) / d2 AS x2,
             (y - cy) / sy AS y FROM raw JOIN sc ON sc.asset = raw.asset AND sc.fold_idx = raw.fold_idx),
        tw AS (SELECT a.asset, a.fold_idx, date_diff('hour', a.time, t.time) AS step, a.x1, a.x2, t.y
             FROM z a JOIN z t ON t.asset = a.asset AND t.fold_idx = a.fold_idx
               AND t.time >= a.time AND t.time < a.time + to_hours(24)
             WHERE a.time < a.train_end - to_hours(48)),
        pw AS (SELECT lg.asset, f.fold_idx, (x1 - c1) / d1 AS x1, (x2 - c2) / d2 AS x2, cy, sy
             FROM lg JOIN oos f ON lg.time = f.test_start JOIN sc ON sc.asset = lg.asset AND sc.fold_idx = f.fold_idx)""",
        NORMAL,
        """p AS MATERIALIZED (SELECT pr.asset, pr.fold_idx, step, f.test_start + to_hours(step) AS time, prediction,
             f.train_end - to_hours(25) AS last_train_label_ts FROM pr JOIN oos f ON f.fold_idx = pr.fold_idx)""",
    ]


def _two_lags(d, offset=1.0):
    panel = d.lite(offset)
    schedule = d.calendar(panel).schedule("oos")
    model = RidgeDMS(1.0, input_columns=("log_return_lag_1", "log_return_lag_2"))
    return panel, schedule, model


@query(
    "walk_forward_tabular",
    sql.query(
        *_tabular_sql(1.0),
        sql.out("asset fold_idx step:i time prediction:d last_train_label_ts", "p"),
    ),
)
def _(d):
    panel, schedule, model = _two_lags(d)
    done = walkforward.walk_forward(panel, schedule, model, horizon=24, lags=2)
    return done.select("asset", "fold_idx", "step", "time", "prediction", "last_train_label_ts")


@query(
    "walk_forward_tabular_lag_columns",
    sql.query(*_tabular_sql(1.0), sql.out("asset fold_idx step:i time prediction:d", "p")),
)
def _(d):
    """Lags as columns of the panel instead of built inside the task."""
    panel = add_lagged_returns(d.bars(), 2)
    panel = apply_features(panel.on_grid(), LITE_CONFIG).on_grid()
    schedule = d.calendar(d.lite()).schedule("oos")
    model = RidgeDMS(1.0, input_columns=("log_return_lag_1", "log_return_lag_2"))
    done = walkforward.walk_forward(panel, schedule, model, horizon=24, folds_per_task=4)
    return done.select("asset", "fold_idx", "step", "time", "prediction")


def _expanding_tabular_sql() -> list[str]:
    """The same on expanding folds from the first row on, whose first three rows have no two lags."""
    first, lite, _, fits, *rest = _tabular_sql(1.0)
    fits = fits.replace("log_return AS y\n             FROM lite", "log_return AS y,\n               row_number() OVER w AS rn FROM lite")
    fits = fits.replace("x1, x2, y FROM lg JOIN oos f\n", "x1, x2, y FROM lg JOIN oos f ON rn > 3\n").replace("             ON lg.time >= f.train_start", "             AND lg.time >= f.train_start")
    return [first, lite, _splits_sql("expanding") + ", oos AS (SELECT * FROM q)", fits, *rest]


@query(
    "walk_forward_expanding",
    sql.query(
        *_expanding_tabular_sql(),
        sql.out("asset fold_idx step:i time prediction:d last_train_label_ts", "p"),
    ),
)
def _(d):
    """Growing training windows: normal equations are added up, no row is read per fold."""
    panel, _, model = _two_lags(d)
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36, mode="expanding")
    done = walkforward.walk_forward(panel, schedule, model, horizon=24, lags=2)
    return done.select("asset", "fold_idx", "step", "time", "prediction", "last_train_label_ts")


SEQUENCE = [
    *CAL,
    """f0 AS MATERIALIZED (SELECT l.asset, l.time, f.fold_idx, f.train_end, log_return_1 AS x, log_return AS y
         FROM lite l JOIN {folds} f ON l.time >= f.train_start AND l.time < f.train_end),
    raw AS (SELECT * FROM f0 WHERE time < train_end - to_hours(24)),
    sc AS MATERIALIZED (SELECT asset, fold_idx, avg(x) AS cx, stddev_pop(x) AS dx, avg(y) AS cy, stddev_pop(y) AS sy
         FROM raw GROUP BY 1, 2),
    z AS MATERIALIZED (SELECT f0.asset, f0.time, f0.fold_idx, (x - cx) / dx AS x, (y - cy) / sy AS y,
           date_diff('hour', f0.time, f0.train_end) AS back
         FROM f0 JOIN sc ON sc.asset = f0.asset AND sc.fold_idx = f0.fold_idx),
    inner_ AS (SELECT *, CASE WHEN back > 24 + 43 THEN 'train' WHEN back > 24 THEN 'val' ELSE 'cut' END AS part
         FROM z),
    sw AS MATERIALIZED (SELECT a.asset, a.fold_idx, a.time, a.part, a.x AS x1, b.x AS x2,
           date_diff('hour', b.time, t.time) - 1 AS step, t.y
         FROM inner_ a JOIN inner_ b ON b.asset = a.asset AND b.fold_idx = a.fold_idx
           AND b.time = a.time + to_hours(1) AND b.part = a.part
         JOIN inner_ t ON t.asset = a.asset AND t.fold_idx = a.fold_idx AND t.part = a.part
           AND t.time > b.time AND t.time <= b.time + to_hours(24)
         JOIN inner_ e ON e.asset = a.asset AND e.fold_idx = a.fold_idx AND e.part = a.part
           AND e.time = a.time + to_hours(25)
         WHERE a.part <> 'cut'),
    tw AS (SELECT * FROM sw WHERE part = 'train'),
    pw AS (SELECT a.asset, a.fold_idx, a.x AS x1, b.x AS x2, cy, sy FROM z a JOIN z b
         ON b.asset = a.asset AND b.fold_idx = a.fold_idx AND b.back = 1 AND a.back = 2
         JOIN sc ON sc.asset = a.asset AND sc.fold_idx = a.fold_idx)""",
    NORMAL,
    """vl AS (SELECT sw.asset, sw.fold_idx, avg(pow(my + w1 * (x1 - m1) + w2 * (x2 - m2) - y, 2)) AS val_loss
         FROM sw JOIN wt ON wt.asset = sw.asset AND wt.fold_idx = sw.fold_idx AND wt.step = sw.step
         WHERE part = 'val' GROUP BY 1, 2)""",
]


def _sequence_panel(d):
    panel = d.lite()
    return type(panel)(
        panel.df.drop("log_volume"), ("log_return_1",), ("log_return",)
    ).on_grid()


@query(
    "walk_forward_sequence",
    sql.query(
        *[part.replace("{folds}", "oos") for part in SEQUENCE],
        """q AS (SELECT pr.asset, pr.fold_idx, step, f.test_start + to_hours(step) AS time, prediction, val_loss
             FROM pr JOIN oos f ON f.fold_idx = pr.fold_idx
             JOIN vl ON vl.asset = pr.asset AND vl.fold_idx = pr.fold_idx)""",
        sql.out("asset fold_idx step:i time prediction:d val_loss:d", "q"),
    ),
)
def _(d):
    panel = _sequence_panel(d)
    schedule = d.calendar(panel).schedule("oos")
    done = walkforward.walk_forward(
        panel, schedule, RidgeSequence(1.0), horizon=24, lookback=2, val_ratio=0.3
    )
    return done.select("asset", "fold_idx", "step", "time", "prediction", "val_loss")


GRID = [{"alpha": 1.0}, {"alpha": 30.0}, {"alpha": 900.0}]


def _grid_sql() -> str:
    base = [part.replace("{folds}", "sparse") for part in SEQUENCE]
    normal, loss = base[-2], base[-1]
    ctes = base[:-2]
    for n, c in enumerate(GRID):
        named = normal.split(",\npr AS")[0].replace("+ 1.0", f"+ {c['alpha']}")
        named = named.replace("nm AS", f"nm{n} AS").replace("FROM nm)", f"FROM nm{n})")
        ctes.append(named.replace("wt AS", f"wt{n} AS"))
        ctes.append(loss.replace("vl AS", f"vl{n} AS").replace("JOIN wt ON", f"JOIN wt{n} wt ON"))
    union = " UNION ALL ".join(
        f"SELECT asset, {n} AS trial, fold_idx, val_loss FROM vl{n}" for n in range(len(GRID))
    )
    return [*ctes, f"ls AS MATERIALIZED ({union})"]


def _expanding_grid_sql() -> list[str]:
    """The grid on expanding folds, whose validation blocks grow with them."""
    size = "greatest(floor((date_diff('hour', train_start, train_end) - 24) * 0.3::DOUBLE), 26)"
    out = []
    for part in _grid_sql():
        part = part.replace("JOIN sparse f", "JOIN q f").replace("f.train_end, log_return_1", f"f.train_end, {size} AS size, log_return_1")
        part = part.replace("date_diff('hour', f0.time, f0.train_end) AS back", "date_diff('hour', f0.time, f0.train_end) AS back, size")
        out.append(part.replace("24 + 43", "24 + size"))
    return [*LITE, _splits_sql("expanding"), *out[len(CAL):]]


@query(
    "score_grid_expanding",
    sql.query(*_expanding_grid_sql(), sql.out("asset trial:i fold_idx val_loss:d", "ls")),
)
def _(d):
    """A search over growing windows: validation losses come from moments, too."""
    panel = _sequence_panel(d)
    schedule = cal.splits_of(panel, train="10d", test="24h", step=36, mode="expanding")
    return tuning.score_grid(
        panel, schedule, RidgeSequence(), GRID, horizon=24, lookback=2, val_ratio=0.3
    )


def _losses(d):
    panel = _sequence_panel(d)
    return tuning.score_grid(
        panel, d.calendar(panel).schedule("in_sample"), RidgeSequence(), GRID,
        horizon=24, lookback=2, val_ratio=0.3,
    )


@query(
    "score_grid",
    sql.query(*_grid_sql(), sql.out("asset trial:i fold_idx val_loss:d", "ls")),
)
def _(d):
    return _losses(d)


@query(
    "running_score",
    sql.query(
        *_grid_sql(),
        """q AS (SELECT asset, trial, fold_idx, avg(val_loss) OVER (PARTITION BY asset, trial
             ORDER BY fold_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_score FROM ls)""",
        sql.out("asset trial:i fold_idx running_score:d", "q"),
    ),
)
def _(d):
    return tuning.running_score(_losses(d)).select("asset", "trial", "fold_idx", "running_score")


@query(
    "best_trial",
    sql.query(
        *_grid_sql(),
        """t AS (SELECT asset, trial, avg(val_loss) AS score FROM ls GROUP BY 1, 2),
        q AS (SELECT asset, arg_min(trial, score) AS best_trial, min(score) AS best_value FROM t GROUP BY 1)""",
        sql.out("asset best_trial:i best_value:d", "q"),
    ),
)
def _(d):
    return tuning.best_trial(tuning.trial_scores(_losses(d)))


class NearestCentroid:
    """A tiny classifier of signs, for the probability rule of classifiers."""

    def fit(self, X, y):
        self.up = X[y > 0].mean(axis=0) if (y > 0).any() else np.zeros(X.shape[1])
        self.down = X[y <= 0].mean(axis=0) if (y <= 0).any() else np.zeros(X.shape[1])

    def predict_proba(self, X):
        near = ((X - self.down) ** 2).sum(axis=1) - ((X - self.up) ** 2).sum(axis=1)
        p = 1.0 / (1.0 + np.exp(-near))
        return np.stack([1.0 - p, p], axis=1)


def _classifier_sql() -> list[str]:
    """Means of the scaled inputs by the sign of the label; the nearer mean's side of the logistic curve."""
    first, lite, calendar, fits, _, last = _tabular_sql(1.0)
    return [
        first, lite, calendar, fits.replace("(y - cy) / sy AS y", "y"),
        """ct AS (SELECT asset, fold_idx, step,
             coalesce(avg(x1) FILTER (y > 0), 0) AS u1, coalesce(avg(x2) FILTER (y > 0), 0) AS u2,
             coalesce(avg(x1) FILTER (y <= 0), 0) AS d1, coalesce(avg(x2) FILTER (y <= 0), 0) AS d2
             FROM tw GROUP BY 1, 2, 3),
        pr AS (SELECT ct.asset, ct.fold_idx, step, 1 / (1 + exp(-(
             pow(pw.x1 - d1, 2) + pow(pw.x2 - d2, 2) - pow(pw.x1 - u1, 2) - pow(pw.x2 - u2, 2)))) AS prediction
             FROM ct JOIN pw ON pw.asset = ct.asset AND pw.fold_idx = ct.fold_idx)""",
        last,
    ]


@query(
    "walk_forward_classifier",
    sql.query(*_classifier_sql(), sql.out("asset fold_idx step:i time prediction:d", "p")),
)
def _(d):
    panel, schedule, _ = _two_lags(d)
    model = EstimatorForecaster(
        NearestCentroid(), input_columns=("log_return_lag_1", "log_return_lag_2")
    )
    done = walkforward.walk_forward(
        panel, schedule, model, horizon=24, lags=2, scaler=FoldScaler(scale_labels=False)
    )
    return done.select("asset", "fold_idx", "step", "time", "prediction")


@query("walk_forward_all_features")
def _(d):
    """The default feature set with 24 lags, ridge on all of them."""
    panel = apply_features(d.bars()).on_grid()
    schedule = d.calendar(panel).schedule("oos")
    return walkforward.walk_forward(panel, schedule, RidgeDMS(10.0), horizon=24, lags=24).select(
        "asset", "fold_idx", "step", "time", "prediction"
    )


BACKTEST = """
nx AS (SELECT asset, time, ln(lead(close) OVER (PARTITION BY asset ORDER BY time) / close) AS actual FROM lite),
bt0 AS (SELECT p.asset, p.time, prediction AS predicted, actual, CAST(sign(prediction) AS DOUBLE) AS signal
        FROM p JOIN nx ON nx.asset = p.asset AND nx.time = p.time),
bt1 AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY asset ORDER BY time), 0.0) AS prev_signal FROM bt0),
bt AS MATERIALIZED (SELECT *, signal * actual AS gross_log_return, ln(1 - 0.002 * abs(signal - prev_signal)) AS txn_cost,
         signal * actual + ln(1 - 0.002 * abs(signal - prev_signal)) AS net_log_return FROM bt1)"""


def metrics_sql(returns: str, value: str, order: str, keys: str = "asset", factor: int = 8760) -> str:
    """Metrics of simple returns; last CTE ``mt``."""
    return f"""
me AS (SELECT *, exp(sum(ln(1 + {value})) OVER (PARTITION BY {keys} ORDER BY {order}
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS eq FROM {returns}),
mp AS (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY {order}
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM me),
mt AS (SELECT {keys}, CASE WHEN stddev_samp({value}) = 0 THEN 0
           ELSE avg({value}) / stddev_samp({value}) * sqrt({factor}) END AS sharpe_ratio,
         product(1 + {value}) - 1 AS total_return, min((eq - peak) / peak) AS max_drawdown,
         stddev_samp({value}) * sqrt({factor}) AS volatility,
         coalesce(count(*) FILTER ({value} > 0) / nullif(count(*) FILTER ({value} <> 0 OR {value} IS NULL), 0), 0)
           AS win_rate FROM mp GROUP BY {keys})"""


METRICS = "asset sharpe_ratio:d total_return:d max_drawdown:d volatility:d win_rate:d"


@query(
    "forecast_and_backtest",
    sql.query(
        *_tabular_sql(STEADY), BACKTEST,
        "rt AS (SELECT *, exp(net_log_return) - 1 AS sr FROM bt)",
        metrics_sql("rt", "sr", "time"),
        sql.out(METRICS, "mt"),
    ),
)
def _(d):
    """Events to bars, features, folds, fits, forecasts, positions and metrics."""
    panel, schedule, model = _two_lags(d, STEADY)
    return forecast_and_backtest(panel, schedule, model, horizon=24, lags=2)
