"""SQL fragments shared by the oracle queries. Every fragment is a list of CTEs."""

from __future__ import annotations


def bars(offset: float = 1.0) -> str:
    """Hourly bars of event series; last CTE ``bars``."""
    return f"""
e AS (SELECT event_type || '-' || CAST(user_id // 50 AS VARCHAR) AS asset,
             date_trunc('hour', ts) AS t, ts, event_id, value + {offset} AS p FROM events),
b AS (SELECT asset, t, arg_min(p, ts) AS o, max(p) AS h, min(p) AS l, arg_max(p, ts) AS c,
             count(*) AS n FROM e GROUP BY asset, t),
sp AS (SELECT min(t) AS t0, max(t) AS t1 FROM e),
g AS (SELECT a.asset, r.t FROM (SELECT DISTINCT asset FROM e) a,
             (SELECT unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM sp) r),
j AS (SELECT g.asset, g.t, o, h, l, c, n,
        last_value(c IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.t
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf,
        first_value(o IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.t
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ob
      FROM g LEFT JOIN b ON g.asset = b.asset AND g.t = b.t),
bars AS MATERIALIZED (SELECT asset, t AS time, coalesce(o, cf, ob) AS open, coalesce(h, cf, ob) AS high,
        coalesce(l, cf, ob) AS low, coalesce(cf, ob) AS close, coalesce(n, 0) + 1.0 AS volume,
        row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS i FROM j)"""


# Return, log volume and one-step label, complete rows only; last CTE ``lite``.
LITE = """
lite0 AS (SELECT *, ln(close / lag(close) OVER w) AS log_return_1, ln(volume) AS log_volume,
            ln(lead(close) OVER w / close) AS log_return
          FROM bars WINDOW w AS (PARTITION BY asset ORDER BY time)),
lite AS MATERIALIZED (SELECT * FROM lite0 WHERE log_return_1 IS NOT NULL AND log_return IS NOT NULL)"""

# Every recursive smoother step by step; last CTE ``sm`` with one row per bar.
SMOOTH = """
s0 AS (SELECT *, close - lag(close) OVER w AS move, ln(close / lag(close) OVER w) AS r
       FROM bars WINDOW w AS (PARTITION BY asset ORDER BY time)),
s AS MATERIALIZED (SELECT *, greatest(move, 0) AS gain, greatest(-move, 0) AS loss,
       avg(greatest(move, 0)) OVER w14 AS g14, avg(greatest(-move, 0)) OVER w14 AS l14
       FROM s0 WINDOW w14 AS (PARTITION BY asset ORDER BY time
         ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
sm AS (SELECT asset, i, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS m,
         CAST(NULL AS DOUBLE) AS m2, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS dn
       FROM s WHERE i = 0
       UNION ALL
       SELECT s.asset, s.i, e12 + (s.close - e12) * 2.0 / 13.0, e26 + (s.close - e26) * 2.0 / 27.0,
         CASE WHEN m IS NULL THEN s.r ELSE m + (s.r - m) * 2.0 / 73.0 END,
         CASE WHEN m2 IS NULL THEN s.r * s.r ELSE m2 + (s.r * s.r - m2) * 2.0 / 73.0 END,
         CASE WHEN s.i < 14 THEN NULL WHEN s.i = 14 THEN s.g14 ELSE (up * 13 + s.gain) / 14 END,
         CASE WHEN s.i < 14 THEN NULL WHEN s.i = 14 THEN s.l14 ELSE (dn * 13 + s.loss) / 14 END
       FROM sm JOIN s ON s.asset = sm.asset AND s.i = sm.i + 1)"""

# All default features and the label, incomplete rows kept; last CTE ``feat``.
FEATURES = (
    SMOOTH
    + """,
v AS (SELECT s.*, sm.e12, sm.e26, sm.up, sm.dn,
        CASE WHEN s.i >= 72 THEN sqrt(greatest(m2 - m * m, 0) / (1 - (
          pow(71.0 / 73.0, 2 * (s.i - 1)) + pow(2.0 / 73.0, 2)
          * (1 - pow(71.0 / 73.0, 2 * (s.i - 1))) / (1 - pow(71.0 / 73.0, 2))))) END AS vol,
        CASE WHEN s.i >= 71 THEN stddev_samp(close) OVER (PARTITION BY s.asset ORDER BY s.time
          ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) END AS pstd,
        lead(close) OVER (PARTITION BY s.asset ORDER BY s.time) AS nxt
      FROM s JOIN sm ON s.asset = sm.asset AND s.i = sm.i),
feat AS MATERIALIZED (SELECT asset, time, i, open, high, low, close, volume, r AS log_return_1,
        r / (vol + 1e-8) AS vol_scaled_return, vol AS ewm_volatility,
        CASE WHEN up + dn = 0 THEN 0 ELSE 100 * up / (up + dn) END AS rsi,
        (e12 - e26) / (pstd + 1e-8) AS macd_norm, ln(volume) AS log_volume,
        ln(nxt / close) AS log_return FROM v)"""
)


def calendar(panel: str = "lite") -> str:
    """Cut and fold tables ``oos``, ``dense`` and ``sparse`` of a panel's span."""

    def folds(name: str, n: str, back: str, step: int) -> str:
        return f"""
{name} AS (SELECT CAST(u.k AS BIGINT) AS fold_idx,
        cut + to_hours({step} * u.k - ({back})) AS train_start,
        cut + to_hours({step} * u.k + 168 - ({back})) AS train_end,
        cut + to_hours({step} * u.k + 168 - ({back})) AS test_start,
        cut + to_hours({step} * u.k + 192 - ({back})) AS test_end
      FROM cal, unnest(range(0, {n})) AS u(k))"""

    return f"""
c0 AS (SELECT min(time) AS t0, max(time) AS t1,
         date_diff('hour', min(time), max(time)) + 1 AS n FROM {panel}),
c1 AS (SELECT *, CAST(floor(0.5 * n) AS BIGINT) AS want FROM c0),
c2 AS (SELECT *, (24 - (n - want) % 24) % 24 AS snap FROM c1),
cal AS (SELECT *, want - snap AS d, n - (want - snap) AS n_oos,
          t0 + to_hours(want - snap) AS cut FROM c2),""" + ",".join(
        [
            folds("oos", "n_oos // 24", "168", 24),
            folds("dense", "(d - 168) // 24", "168 + 24 * ((d - 168) // 24)", 24),
            folds("sparse", "(d - 192) // 48 + 1", "192 + 48 * ((d - 192) // 48)", 48),
        ]
    )


# Rows in the out-of-sample folds: ``tr`` untrimmed, ``tm`` trimmed, ``te`` test.
FOLD_ROWS = """
tr AS (SELECT l.*, f.fold_idx, f.train_start, f.train_end FROM lite l JOIN oos f
         ON l.time >= f.train_start AND l.time < f.train_end),
tm AS (SELECT * FROM tr WHERE time < train_end - to_hours(24)),
te AS (SELECT l.*, f.fold_idx, f.test_start, date_diff('hour', f.test_start, l.time) AS step
       FROM lite l JOIN oos f ON l.time >= f.test_start AND l.time < f.test_end)"""

# Momentum forecasts of both halves as stored rows and folds: ``rows_`` and ``folds_``.
STORED = """
halves AS (SELECT 'oos' AS split, * FROM oos UNION ALL SELECT 'in_sample', * FROM dense),
rows_ AS (SELECT l.asset, 'momentum' AS model, 0 AS seed, f.split, f.fold_idx,
            l.time AS timestamp, date_diff('hour', f.test_start, l.time) AS step,
            l.log_return_1 AS forecast, l.log_return AS actual
          FROM lite l JOIN halves f ON l.time >= f.test_start AND l.time < f.test_end),
folds_ AS (SELECT a.asset, 'momentum' AS model, 0 AS seed, f.fold_idx, f.split, f.train_start,
             f.train_end, f.train_end - to_hours(25) AS last_train_label_ts, f.test_start,
             f.test_end FROM (SELECT DISTINCT asset FROM lite) a, halves f)"""


def out(spec: str, source: str) -> str:
    """Final select. ``name:d`` rounds a double, ``name:i`` makes a 64-bit integer."""
    cols = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        if kind == "d":
            cols.append(f"round({name}, 6) + 0.0 AS {name}")
        elif kind == "i":
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            cols.append(name)
    return f"SELECT {', '.join(cols)} FROM {source}"


def query(*parts: str) -> str:
    """CTE lists and a final select."""
    *ctes, final = parts
    return "WITH RECURSIVE " + ",".join(p.strip() for p in ctes) + "\n" + final
