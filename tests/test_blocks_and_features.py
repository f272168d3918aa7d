import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barfold.functions.features import (
    DEFAULT_CONFIG,
    apply_features,
    available_transforms,
    feature_tag,
)
from barfold.operators import blocks
from barfold.panel import Panel
from tests.conftest import bar_frame, to_spark


def _series(spark, seed=1):
    """Three series with holes and missing values; one holds most rows."""
    rng, parts = np.random.default_rng(seed), []
    for key, n in (("hot", 300), ("b", 40), ("c", 1)):
        pos = np.sort(rng.choice(1000, n, replace=False))
        v = rng.normal(size=n)
        v[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"asset": key, "i": pos, "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, to_spark(spark, pdf)


@pytest.mark.parametrize("block_rows", [7, 100, 10000])
def test_running_equals_pandas(spark, block_rows):
    pdf, df = _series(spark)
    out = blocks.running(
        df, ["asset"],
        {"s": ("sum", "v"), "m": ("max", "v"), "p": ("product", 1 + F.col("v")), "l": ("last", "v")},
        position="i", block_rows=block_rows,
    ).toPandas().sort_values(["asset", "i"])
    want = pdf.sort_values(["asset", "i"])
    g = want.groupby("asset")["v"]
    filled = want.assign(z=want.v.fillna(0)).groupby("asset")["z"].cumsum()
    seen = g.transform(lambda x: x.notna().cumsum()) > 0
    np.testing.assert_allclose(out.s, filled.where(seen))
    np.testing.assert_allclose(out.m, g.transform(lambda x: x.cummax().ffill()))
    np.testing.assert_allclose(out.l, g.ffill())
    grown = want.assign(z=(1 + want.v).fillna(1)).groupby("asset")["z"].cumprod()
    np.testing.assert_allclose(out.p, grown.where(seen))


@pytest.mark.parametrize("block_rows", [5, 64, 10000])
def test_previous_crosses_blocks_and_holes(spark, block_rows):
    pdf, df = _series(spark)
    out = blocks.previous(df, ["asset"], {"b": "v", "at": "i"}, position="i", block_rows=block_rows)
    out = out.toPandas().sort_values(["asset", "i"])
    want = pdf.sort_values(["asset", "i"]).groupby("asset")
    np.testing.assert_allclose(out.b, want["v"].shift(1))
    np.testing.assert_allclose(out["at"], want["i"].shift(1))


def test_rank_positions_number_rows(spark):
    pdf = bar_frame(rows=300)
    pdf = pdf[np.random.default_rng(0).random(len(pdf)) < 0.6]
    panel = Panel(to_spark(spark, pdf))
    got = panel.with_row_numbers("n").toPandas().sort_values(["asset", "time"])
    want = pdf.sort_values(["asset", "time"]).groupby("asset").cumcount()
    assert got.n.tolist() == want.tolist()


def test_halo_gives_every_row_one_core(spark):
    df = spark.range(100).withColumnRenamed("id", blocks.POS)
    cut = blocks.with_halo(df, before=3, after=2, block_rows=10).toPandas()
    assert sorted(cut[cut._core]._pos) == list(range(100))
    block = cut[cut._block == 4]._pos
    assert (block.min(), block.max(), len(block)) == (37, 51, 15)


def _features(panel, **options):
    out = apply_features(panel, DEFAULT_CONFIG, drop_incomplete=False, **options)
    return out.df.toPandas().sort_values(["asset", "time"]).reset_index(drop=True)


def test_features_do_not_depend_on_blocks_or_grid(bars):
    _, panel = bars
    one = _features(panel)
    small = _features(panel, block_rows=64)
    ranked = _features(Panel(panel.df))
    for c in apply_features(panel).feature_cols:
        np.testing.assert_allclose(small[c], one[c], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(ranked[c], one[c], rtol=1e-9, atol=1e-12)


def test_features_equal_pandas(bars):
    pdf, panel = bars
    got = _features(panel)
    for asset, g in pdf.groupby("asset"):
        mine, c = got[got.asset == asset], g.close
        r = np.log(c / c.shift(1))
        np.testing.assert_allclose(mine.log_return_1, r, rtol=1e-12)
        vol = r.ewm(span=72, min_periods=72, adjust=False).std()
        np.testing.assert_allclose(mine.ewm_volatility, vol, rtol=1e-9)
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(mine.macd_norm, macd / (c.rolling(72).std() + 1e-8), rtol=1e-8)
        np.testing.assert_allclose(mine.log_return, np.log(c.shift(-1) / c), rtol=1e-12)


@pytest.mark.parametrize("span", [1, 2, 5, 400])
def test_ewm_spans(spark, bars, span):
    pdf, panel = bars
    config = [{"name": "EWM_VOLATILITY", "span": span}]
    got = apply_features(panel, config, drop_incomplete=False, block_rows=50).df.toPandas()
    for asset, g in pdf.groupby("asset"):
        r = np.log(g.close / g.close.shift(1))
        want = r.ewm(span=span, min_periods=span, adjust=False).std()
        mine = got[got.asset == asset].sort_values("time").ewm_volatility
        if span > 1:  # span 1 has no spread: both sides are 0/0
            np.testing.assert_allclose(mine, want, rtol=1e-6, atol=1e-9)


def test_future_bars_change_no_feature(spark, bars):
    pdf, panel = bars
    cut = pdf.time.iloc[300]
    bent = pdf.copy()
    bent.loc[bent.time > cut, ["close", "volume"]] *= 3
    a, b = _features(panel), _features(Panel(to_spark(spark, bent)).on_grid())
    cols = apply_features(panel).feature_cols
    pd.testing.assert_frame_equal(a[a.time <= cut][cols], b[b.time <= cut][cols])


def test_constant_prices(spark):
    pdf = bar_frame(("a",), 120)
    pdf[["open", "high", "low", "close"]] = 5.0
    got = _features(Panel(to_spark(spark, pdf)).on_grid())
    assert (got.rsi.dropna() == 0).all() and got.rsi.notna().sum() == 106
    assert got.macd_norm.abs().max() < 1e-6  # rounding of the means over eps
    assert (got.ewm_volatility.dropna() == 0).all()


def test_missing_price_inside_is_an_error(spark):
    pdf = bar_frame(("a",), 120)
    pdf.loc[50, "close"] = np.nan
    with pytest.raises(Exception, match="missing"):
        apply_features(Panel(to_spark(spark, pdf)).on_grid()).df.collect()


def test_zero_volume_row_is_dropped_and_opens_a_hole(spark):
    from barfold.operators import quality

    pdf = bar_frame(("a",), 200)
    pdf.loc[150, "volume"] = 0.0
    out = apply_features(Panel(to_spark(spark, pdf)).on_grid())
    with pytest.raises(quality.QualityError, match="hourly grid"):
        quality.verify_grid(out)


def test_registry():
    assert {"RSI", "LOG_RETURN", "LAGGED_RETURNS"} <= set(available_transforms())
    assert feature_tag(DEFAULT_CONFIG) == feature_tag([dict(c) for c in DEFAULT_CONFIG])
    assert feature_tag(DEFAULT_CONFIG) != feature_tag(DEFAULT_CONFIG[:-1])


def test_unknown_transform(bars):
    with pytest.raises(KeyError, match="known"):
        apply_features(bars[1], [{"name": "nope"}])
