import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import indicators as I
from barweave.functions import structure as S


def series(spark, closes, ticker="A", spread=0.6, volume=1000.0):
    rows = []
    for i, c in enumerate(closes):
        rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c), float(c) + spread, float(c) - spread, float(c), volume))
    return spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


@pytest.mark.parametrize("closes, expected", [(range(1, 31), 100.0), (range(30, 0, -1), 0.0), ([5] * 30, 50.0)])
def test_rsi_extremes(spark, closes, expected):
    got = column(I.add_recursive(series(spark, closes)), "rsi14")
    assert got[:14] == [None] * 14
    assert all(x == pytest.approx(expected) for x in got[14:])


def test_ema_seed_and_step(spark):
    closes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 20]
    got = column(I.add_recursive(series(spark, closes)), "ema9")
    assert got[:8] == [None] * 8
    assert got[8] == pytest.approx(5.0, rel=1e-12)
    assert got[9] == pytest.approx(20 * 0.2 + 5 * 0.8)


def test_warm_up_points(spark):
    rows = I.add_recursive(series(spark, [100 + 5 * math.sin(i / 3) + 0.1 * i for i in range(60)]))
    first = {c: next(i for i, x in enumerate(column(rows, c)) if x is not None) for c in ("macd", "macd_signal", "atr14", "plus_di", "adx14")}
    assert first == {"macd": 25, "macd_signal": 33, "atr14": 13, "plus_di": 14, "adx14": 27}
    strict = I.add_recursive(series(spark, [100 + i % 7 for i in range(60)]), point_in_time=True)
    assert [next(i for i, x in enumerate(column(strict, c)) if x is not None) for c in ("atr14", "plus_di", "adx14")] == [14, 28, 28]


def test_windows_against_pandas(spark):
    rng = np.random.default_rng(7)
    closes = 100 + np.cumsum(rng.normal(0, 1, 120))
    pdf = I.add_windows(series(spark, closes)).orderBy("ts").toPandas()
    c = pd.Series(closes)
    np.testing.assert_allclose(pdf["sma20"], c.rolling(20).mean(), rtol=1e-9)
    np.testing.assert_allclose(pdf["bb_width"], 4 * c.rolling(20).std(ddof=0) / c.rolling(20).mean(), rtol=1e-9)
    np.testing.assert_allclose(pdf["hist_vol20"], np.log(c / c.shift()).rolling(20).std() * np.sqrt(252), rtol=1e-9)
    np.testing.assert_allclose(pdf["roc12"], (c / c.shift(12) - 1) * 100, rtol=1e-9)
    assert pdf["rel_volume"].notna().idxmax() == 20


def test_features_do_not_look_ahead(spark):
    """Rows up to t are the same whether the series ends at t or goes on."""
    closes = [100 + 8 * math.sin(i / 5) + 0.2 * i for i in range(90)]
    names = ["sma20", "rsi14", "adx14", "atr14", "stoch_k", "trend", "last_sh", "resistance20", "l2", "peak"]

    def wide(n):
        return S.add_pattern_frames(S.add_structure(I.features_daily(series(spark, closes[:n])))).orderBy("ts").select(*names).toPandas()

    short, long = wide(70), wide(90).head(70)
    pd.testing.assert_frame_equal(short, long)


def test_look_ahead_is_detected(spark):
    closes = [100 + 8 * math.sin(i / 5) for i in range(60)]
    peek = lambda n: column(series(spark, closes[:n]).withColumn("x", F.lead("close").over(I.by_ticker())), "x")
    assert peek(40) != peek(60)[:40]


def test_swings_need_full_frames(spark):
    highs = [1, 2, 3, 9, 3, 2, 1, 2, 3, 8, 3, 2]
    found = S.add_swings(series(spark, highs))
    assert [i for i, x in enumerate(column(found, "swing_high")) if x is not None] == [3]
    assert [i for i, x in enumerate(column(found, "last_sh")) if x is not None][0] == 6


def _smoothed(x, n, first, keep, gain, seed):
    """keep * y + gain * x from the seed on, bar by bar."""
    out, at = [None] * len(x), first + n - 1
    for i in range(at, len(x)):
        out[i] = sum(x[first : at + 1]) * seed if i == at else out[i - 1] * keep + x[i] * gain
    return out


def _by_loops(high, low, close):
    n = len(close)
    ema = lambda x, k, first=0: _smoothed(x, k, first, 1 - 2 / (k + 1), 2 / (k + 1), 1 / k)
    mean = lambda x, k, first: _smoothed(x, k, first, (k - 1) / k, 1 / k, 1 / k)
    total = lambda x: _smoothed(x, 14, 1, 1 - 1 / 14, 1.0, 1.0)
    out = {f"ema{k}": ema(close, k) for k in (9, 12, 21, 26, 50)}
    move = [0.0] + [close[i] - close[i - 1] for i in range(1, n)]
    for k in (9, 14):
        gain, loss = mean([max(x, 0.0) for x in move], k, 1), mean([max(-x, 0.0) for x in move], k, 1)
        out[f"rsi{k}"] = [None if g is None else (50.0 if g == 0 else 100.0) if lo == 0 else 100 - 100 / (1 + g / lo) for g, lo in zip(gain, loss)]
    out["macd"] = [None if b is None else a - b for a, b in zip(out["ema12"], out["ema26"])]
    out["macd_signal"] = ema(out["macd"], 9, 25)
    out["macd_hist"] = [None if b is None else a - b for a, b in zip(out["macd"], out["macd_signal"])]
    reach = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]
    up, down = [0.0] + [high[i] - high[i - 1] for i in range(1, n)], [0.0] + [low[i - 1] - low[i] for i in range(1, n)]
    out["atr14"] = mean(reach, 14, 0)
    sums = [total(x) for x in (reach, [u if u > d and u > 0 else 0.0 for u, d in zip(up, down)], [d if d > u and d > 0 else 0.0 for u, d in zip(up, down)])]
    out["plus_di"], out["minus_di"] = ([None if t is None else 0.0 if t == 0 else x / t * 100 for x, t in zip(side, sums[0])] for side in sums[1:])
    dx = [None if p is None else 0.0 if p + m == 0 else abs(p - m) / (p + m) * 100 for p, m in zip(out["plus_di"], out["minus_di"])]
    out["adx14"] = mean(dx, 14, 14)
    return out


@pytest.mark.parametrize("block, halo", [(600, 512), (570, 512), (2048, 512)])
def test_scans_over_blocks_equal_loops(spark, block, halo):
    """Walks with flat stretches that are longer than a block, cut into many blocks."""
    rng = np.random.default_rng(3)
    steps = rng.normal(0, 1, 1700)
    steps[500:1200] = 0.0
    close = np.round(200 + np.cumsum(steps), 2)
    high, low = close + rng.uniform(0, 1, 1700).round(2), close - rng.uniform(0, 1, 1700).round(2)
    high[500:1200], low[500:1200] = close[500:1200], close[500:1200]
    day = [dt.date(2019, 1, 1) + dt.timedelta(days=int(i)) for i in range(1700)]
    rows = [("A", d, float(c), float(h), float(lo), float(c), 10.0) for d, c, h, lo in zip(day, close, high, low)]
    rows += [("B", *r[1:]) for r in rows[:40]]
    bars = spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume double")
    got = I.add_recursive(bars, block=block, halo=halo).orderBy("ticker", "ts").toPandas()
    for ticker, n in (("A", 1700), ("B", 40)):
        want = _by_loops(*([float(x) for x in xs[:n]] for xs in (high, low, close)))
        for name in I.RECURSIVE:
            np.testing.assert_allclose(got.loc[got["ticker"] == ticker, name].astype(float), np.array(want[name], dtype=float), rtol=1e-9, atol=1e-9, err_msg=f"{ticker} {name}")


def test_features_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(4)
    bars = series(spark, 100 + np.cumsum(rng.normal(0, 1, 1300)))
    wide = lambda block: I.features_daily(bars, block=block).orderBy("ts").toPandas()
    cut, whole = wide(600), wide(2048)
    assert cut["rn"].tolist() == list(range(1, 1301)) and set(cut.columns) == set(whole.columns)
    pd.testing.assert_frame_equal(cut[whole.columns], whole, rtol=1e-9, atol=1e-9)


def test_one_ticker_spreads_over_blocks_without_python(spark):
    from barweave.functions import scans

    bars = spark.range(20000).select(F.lit("A").alias("ticker"), F.date_add(F.lit("1960-01-01").cast("date"), F.col("id").cast("int")).alias("ts"), *[(100 + F.col("id") % 17).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = I.add_recursive(bars)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    sizes = scans.in_blocks(scans.number_bars(bars), lambda rows: rows.withColumn("b", F.col("ticker.block")), {}).groupBy("b").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) == scans.BLOCK
