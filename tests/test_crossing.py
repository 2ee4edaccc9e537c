"""First crossings and extremes against loops over the bars."""

import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import crossing as C
from barweave.operators import signals as N


def _series(spark, seed, tickers=3, n=400):
    random.seed(seed)
    rows, price = [], {t: 100.0 for t in range(tickers)}
    for t in range(tickers):
        for i in range(n if t else 7):
            price[t] += random.uniform(-2, 2)
            spread = random.uniform(0, 1.5)
            low, high = price[t] - spread, price[t] + spread
            rows.append((f"t{t}", i + 1, None if random.random() < 0.02 else low, None if random.random() < 0.02 else high))
    return rows, spark.createDataFrame(rows, "ticker string, rn int, low double, high double")


@pytest.mark.parametrize("fanout, levels", [(32, 4), (2, 3), (4, 4), (3, 1)])
def test_first_crossing(spark, fanout, levels):
    rows, bars = _series(spark, fanout)
    bar = {(t, n): (low, high) for t, n, low, high in rows}
    asks = []
    for i in range(150):
        t, n, low, high = random.choice(rows)
        middle = low if low is not None else 100.0
        reach = random.choice([0.5, 3, 12, 60])
        asks.append((i, t, n, None if i % 17 == 0 else middle - reach, None if i % 19 == 0 else middle + reach))
    df = spark.createDataFrame(asks, "id int, ticker string, start int, stop double, target double")
    nodes = C.block_nodes(bars, fanout, levels)
    got = {r["id"]: r["hit_rn"] for r in C.first_crossing(df, nodes, ("ticker", "id"), "start", "stop", "target", fanout, levels).collect()}
    want = {}
    for i, t, n, stop, target in asks:
        while (t, n) in bar:
            low, high = bar[t, n]
            if (None not in (low, stop) and low <= stop) or (None not in (high, target) and high >= target):
                want[i] = n
                break
            n += 1
    assert got == want and 20 < len(want) < 150


@pytest.mark.parametrize("fanout, levels", [(32, 4), (2, 3), (3, 5)])
def test_range_extremes(spark, fanout, levels):
    rows, bars = _series(spark, 9)
    size = {}
    for t, n, *_ in rows:
        size[t] = max(size.get(t, 0), n)
    asks = []
    for i in range(120):
        t = random.choice(list(size))
        a = random.randint(1, size[t])
        asks.append((i, t, a, random.randint(a, size[t])))
    df = spark.createDataFrame(asks, "id int, ticker string, start int, end int")
    got = C.range_extremes(df, C.block_nodes(bars, fanout, levels), ("ticker", "id"), "start", "end", fanout, levels)
    got = {r["id"]: (r["high"], r["low"]) for r in got.collect()}
    for i, t, a, b in asks:
        held = [r for r in rows if r[0] == t and a <= r[1] <= b]
        highs, lows = [r[3] for r in held if r[3] is not None], [r[2] for r in held if r[2] is not None]
        assert got[i] == (max(highs, default=None), min(lows, default=None))


def test_nodes_spread_a_ticker_over_rows(spark):
    bars = spark.range(1, 5001).select(F.lit("x").alias("ticker"), F.col("id").alias("rn"), F.lit(1.0).alias("low"), F.lit(2.0).alias("high"))
    nodes = C.block_nodes(bars)
    sizes = [(r["level"], r["n"]) for r in nodes.groupBy("level").agg(F.max(F.size("parts")).alias("n")).collect()]
    assert sorted(sizes) == [(0, 32), (1, 32), (2, 5), (3, 1)]
    assert nodes.where("level = 0").count() == 157


def test_trades_are_held_until_an_exit_however_long(spark):
    """A target that is reached after 900 bars, one at the next bar, and one that never is."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    price = F.when(F.col("id") == 950, 200.0).otherwise(100.0)
    bars = spark.range(1000).select(F.lit("x").alias("ticker"), day.alias("ts"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    found = spark.createDataFrame([(50, "a", 150.0, 90.0), (948, "b", 150.0, 90.0), (960, "c", 150.0, 90.0), (999, "d", 150.0, 90.0)], "rn int, strategy string, target double, stop double")
    found = found.join(bars.withColumn("rn", F.datediff("ts", F.lit("2000-01-01")) + 1).select("ticker", "ts", "rn"), "rn")
    found = found.withColumns({"entry": F.lit(100.0), "score": F.lit(1.0), "regime": F.lit("r")})
    got = {r["strategy"]: (r["exit_reason"], r["exit_rn"], r["bars_held"]) for r in N.trade_outcomes(found, bars).collect()}
    # Bar 951 opens at 200: "b" enters there, and its target moves to 250.
    assert got == {"a": ("target", 951, 901), "b": ("target", 951, 3), "c": ("end_of_data", 1000, 40), "d": ("end_of_data", 1000, 1)}
