import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barweave.functions.scalars import check_exit, dto_round, position_size, risk_reward
from barweave.operators import backtest as K
from barweave.operators import calendar as C
from barweave.operators import intraday as Y
from barweave.operators import metrics as M
from barweave.operators import patterns as P
from barweave.operators import quality as Q
from barweave.operators import reports as H
from barweave.operators import research as R
from barweave.operators import strategies as G
from barweave.sources import bars as B


@pytest.mark.parametrize(
    "bar, expected",
    [((100, 105, 95), None), ((100, 105, 89), ("stop", 90.0)), ((100, 111, 95), ("target", 110.0)), ((100, 111, 89), ("stop", 90.0)), ((85, 95, 84), ("stop", 85.0)), ((115, 120, 112), ("target", 110.0)), ((100, 105, 90), ("stop", 90.0)), ((100, 110, 95), ("target", 110.0))],
)
def test_exit_truth_table(spark, bar, expected):
    o, h, low = (F.lit(float(x)) for x in bar)
    got = spark.range(1).select(check_exit(o, h, low, F.lit(90.0), F.lit(110.0)).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == expected


def test_scalars(spark):
    row = spark.range(1).select(
        risk_reward(F.lit(100.0), F.lit(95.0), F.lit(110.0)).alias("rr"), risk_reward(F.lit(100.0), F.lit(100.0), F.lit(110.0)).alias("none"),
        position_size(F.lit(100000.0), 0.01, F.lit(100.0), F.lit(95.0)).alias("n"), position_size(F.lit(100000.0), 0.01, F.lit(100.0), F.lit(100.0)).alias("zero"), dto_round(F.lit(-2.5), 0).alias("half"),
    ).first()
    assert (row["rr"], row["none"], row["n"], row["zero"], row["half"]) == (2.0, None, 200, 0, -2.0)


def test_known_holidays(spark):
    found = {(r["holiday"], r["dt"]) for r in C.us_holidays(spark, 2021, 2024).collect()}
    assert ("Good Friday", dt.date(2024, 3, 29)) in found
    assert ("Thanksgiving", dt.date(2023, 11, 23)) in found
    assert ("Independence Day", dt.date(2021, 7, 5)) in found
    assert ("Memorial Day", dt.date(2022, 5, 30)) in found
    assert ("New Year", dt.date(2021, 12, 31)) in found and not any(h == "Juneteenth" and d.year < 2022 for h, d in found)


def test_trading_days_skip_weekends_and_holidays(spark):
    days = spark.sql("select explode(sequence(date'2024-03-28', date'2024-04-01')) as ts")
    assert sorted(str(r[0]) for r in C.trading_days(days, spark).collect()) == ["2024-03-28", "2024-04-01"]


def bars(spark, rows):
    return spark.createDataFrame([("A", dt.date(2024, 1, d), *map(float, x)) for d, *x in rows], "ticker string, ts date, open double, high double, low double, close double, volume double")


def test_bar_issues(spark):
    rows = bars(spark, [(1, 10, 11, 9, 10, 5), (2, 10, 9, 11, 10, 5), (3, 20, 21, 19, 20, 0), (10, -1, 21, 19, 20, 5)])
    codes = {(r["ts"].day if r["ts"] else None, r["code"]) for r in Q.bar_issues(rows).collect()}
    assert {(2, "INVALID_HIGH_LOW"), (3, "ZERO_VOLUME"), (3, "LARGE_GAP"), (10, "NEGATIVE_PRICE"), (10, "DATE_GAPS"), (None, "INSUFFICIENT_HISTORY")} <= codes


def test_pattern_rules_on_literals(spark):
    row = "select 102d close, 100d resistance20, 2.25d rel_volume, 101d hi15p, 99d lo15p"
    got = P.add_patterns(spark.sql(row), "breakout", "breakout_from_consolidation").first()
    assert got["breakout"] and got["breakout_confidence"] == pytest.approx(1.0) and got["breakout_invalidation"] == pytest.approx(98.0)
    assert got["breakout_from_consolidation"] and got["breakout_from_consolidation_confidence"] == pytest.approx(0.5 * (1 - 0.02 / 0.08) + 0.5)
    quiet = P.add_patterns(spark.sql(row.replace("2.25d", "cast(null as double)")), "breakout").first()
    assert quiet["breakout"] is False and quiet["breakout_confidence"] == 0


def test_weights_and_registry():
    with pytest.raises(ValueError):
        G.validate_weights({"a": 0.5, "b": 0.6})
    with pytest.raises(ValueError):
        G.register(dict(G.DAILY), G.DAILY["breakout"])


def test_trade_aggregates(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", -5.0), ("a", 0.0), ("b", 3.0)], "k string, net double")
    got = {r["k"]: r for r in M.trade_metrics(rows, "k").collect()}
    assert (got["a"]["trades"], got["a"]["wins"], got["a"]["losses"], got["a"]["profit_factor"]) == (3, 1, 1, 2.0)
    assert got["b"]["profit_factor"] == math.inf and got["a"]["expectancy"] == pytest.approx(5 / 3)


def test_streaks_break_even_resets(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 1.0, 0.0, 1.0, -1.0, -1.0, -1.0])], "k string, n int, net double")
    assert tuple(M.streaks(rows, "k", ("n",)).first())[1:] == (2, 3)


def test_rank_statistics(spark):
    rows = spark.createDataFrame([(float(i), float(i) * 2, i > 3) for i in range(8)], "x double, y double, w boolean")
    got = R.rank_statistics(rows, "y", "w", ("x",)).first()
    assert got["spearman"] == pytest.approx(1.0) and got["auc"] == pytest.approx(1.0)


def test_deciles_differ(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(23)], "k string, n int, v double")
    ceil = {r["decile"]: r["count"] for r in R.ceil_deciles(rows, ("k",), "v", ("n",)).groupBy("decile").count().collect()}
    assert ceil == {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 2}
    even = R.score_deciles(rows.withColumn("net", F.col("v")), "k", "v", ("n",)).orderBy("decile").collect()
    assert [r["n"] for r in even] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_patterns_keep_their_invalidation_without_a_hit(spark):
    row = "select 100d close, 90d l2, 95d l3, cast(null as double) peak, 110d h2, 108d h3, cast(null as double) trough, 99d resistance20, 2d rel_volume, 140d hi15p, 60d lo15p"
    got = P.add_patterns(spark.sql(row), "double_bottom", "double_top", "breakout_from_consolidation").first()
    assert (got["double_bottom"], got["double_bottom_invalidation"]) == (False, 90.0)
    assert (got["double_top"], got["double_top_invalidation"]) == (False, 110.0)
    assert (got["breakout_from_consolidation"], got["breakout_from_consolidation_invalidation"]) == (False, pytest.approx(97.02))


def daily(spark, rows, ticker="A"):
    return spark.createDataFrame([(ticker, dt.date(2024, 1, 1) + dt.timedelta(d), *map(float, x)) for d, *x in rows], "ticker string, ts date, open double, high double, low double, close double, volume double")


def test_consolidation_has_a_confidence_without_a_hit(spark):
    from barweave.functions.structure import add_consolidation

    rows = add_consolidation(daily(spark, [(i, 100, 102, 98, 100, 1) for i in range(5)] + [(5, 100, 120, 98, 100, 1)]), n=3).orderBy("ts").collect()
    assert [r["range_pct"] is None for r in rows] == [True, True, False, False, False, False]
    assert rows[2]["consolidates"] and rows[2]["consolidation_confidence"] == pytest.approx(0.5)
    assert not rows[5]["consolidates"] and rows[5]["consolidation_confidence"] == 0 and rows[0]["consolidation_confidence"] == 0


def test_windows_need_history_and_all_their_days(spark):
    days = spark.range(23).selectExpr("date_add(date'2024-01-01', cast(id as int)) as ts")
    got = [tuple(r) for r in K.walk_forward_windows(days, 5, 6).orderBy("window").collect()]
    assert got == [(0, dt.date(2024, 1, 6), dt.date(2024, 1, 11)), (1, dt.date(2024, 1, 12), dt.date(2024, 1, 17)), (2, dt.date(2024, 1, 18), dt.date(2024, 1, 23))]
    trades = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 1, 12), 2.0)], "signal_ts date, net double")
    assert [(r["window"], r["net"]) for r in K.in_windows(trades, K.window_days(days, 5, 6)).collect()] == [(1, 2.0)]


def test_exclusions_leave_out_the_best(spark):
    trades = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 4.0), ("c", -1.0)], "ticker string, net double")
    got = {(r["left_out"], r["ticker"]): r["n"] for r in K.without_best(trades, (0, 1, 2)).groupBy("left_out", "ticker").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "a"): 2, (0, "b"): 1, (0, "c"): 1, (1, "b"): 1, (1, "c"): 1, (2, "c"): 1}


def session(spark, path):
    t0 = dt.datetime(2024, 1, 2, 15)
    return spark.createDataFrame([("A", dt.date(2024, 1, 2), i + 1, t0 + dt.timedelta(hours=i), *map(float, x)) for i, x in enumerate(path)], "ticker string, ny_day date, day_bar int, ts timestamp, open double, high double, low double, close double")


@pytest.mark.parametrize(
    "path, reason, got",
    [
        ([(100, 101, 99, 100), (100, 100.5, 99.5, 100), (109, 110.5, 108.9, 110)], "target", 110.0),
        ([(100, 101, 99, 100), (100, 101, 100, 101), (104, 105, 103.5, 104), (103.5, 103.5, 102, 102)], "stop", 102.9),  # the stop trails the high
        ([(100, 101, 99, 100), (100, 100, 90, 92)], "stop", 98.0),
        ([(100, 101, 99, 100), (100, 101, 99.5, 100.5), (100, 101, 99.5, 100.2)], "end_of_day", 100.2),
    ],
)
def test_intraday_outcomes(spark, path, reason, got):
    bars = session(spark, path)
    found = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 15), "s", 100.0, 95.0, 110.0, 80.0)], "ticker string, ts timestamp, strategy string, entry double, stop double, target double, score double")
    row = K.intraday_outcomes(found, bars, slippage_bps=0.0).first()
    assert (row["exit_reason"], row["got"], row["paid"]) == (reason, pytest.approx(got), 100.0)


def test_scan_cycle_takes_a_ticker_once_and_fills_slots_in_order(spark):
    day = dt.date(2024, 1, 2)
    rows = [("A", 15, "x", 90.0), ("A", 16, "y", 99.0), ("B", 15, "x", 80.0), ("C", 15, "x", 85.0), ("D", 16, "x", 95.0), ("E", 15, "x", 60.0)]
    scored = spark.createDataFrame([(t, dt.datetime(2024, 1, 2, h), s, x, "BUY" if x >= 75 else "WATCH", day, 100.0, 95.0) for t, h, s, x in rows], "ticker string, ts timestamp, strategy string, score double, class string, ny_day date, entry double, stop double")
    got = [(r["slot"], r["ticker"], r["strategy"], r["shares"]) for r in Y.scan_cycle(scored, slots=3).orderBy("slot").collect()]
    assert got == [(1, "A", "x", 100), (2, "C", "x", 100), (3, "B", "x", 100)]


def test_reports(spark):
    bars = daily(spark, [(0, 1, 1, 1, 10, 1), (1, 1, 1, 1, 11, 1)]).unionByName(daily(spark, [(1, 1, 1, 1, 5, 1)], "B"))
    got = {(r["ticker"], r["ts"].day): (r["change_pct"], r["place"]) for r in H.movers(bars).collect()}
    assert got == {("A", 1): (None, 1), ("A", 2): (pytest.approx(10.0), 1), ("B", 2): (None, 2)}
    sectors = spark.createDataFrame([("A", "X"), ("B", None)], "ticker string, sector string")
    assert {r["ticker"] for r in H.with_sector(bars, sectors).collect()} == {"A"}
    assert H.locked_day(bars, F.lit(dt.date(2024, 1, 2))).first()["i"] == 1
    with pytest.raises(Exception, match="no bars on 2024-01-05"):
        H.locked_day(bars, F.lit(dt.date(2024, 1, 5))).collect()
    money = spark.createDataFrame([(1, "usd"), (2, None), (3, "EUR")], "k int, currency string")
    assert {r["k"] for r in H.in_currency(money, "currency").collect()} == {1, 2}
    assert Q.exclude_tickers(bars, spark.createDataFrame([("a",)], "ticker string")).count() == 1
    good, bad = Q.split_sane(daily(spark, [(0, 1, 2, 1, 1, 1), (1, 1, 1, 2, 1, 1)]))
    assert (good.count(), bad.count()) == (1, 1)


def test_reports_on_charts_bars_and_symbols(spark):
    rows = daily(spark, [(i, 1, 1, 1, 10 + i, 1) for i in range(4)])
    features = rows.withColumns({c: F.lit(1.0) for c in ("sma20", "rsi14")})
    assert H.chart_bundle(features, "sma20", "rsi").columns == ["ticker", "ts", "open", "high", "low", "close", "sma20", "rsi14"]
    with pytest.raises(ValueError):
        H.chart_bundle(features, "moon")
    gaps = rows.withColumn("open", F.when(F.col("close") != 13, F.col("open")))
    assert sorted(r["close"] for r in H.recent_bars(gaps, 2).collect()) == [11.0, 12.0]
    names = spark.createDataFrame([("AB", "Zed", "x"), ("ZA", "Abel", "x"), ("AC", "q", "y")], "symbol string, name string, kind string")
    assert [r["symbol"] for r in H.search_symbols(names, F.lit(" a ")).collect()] == ["AB", "AC", "ZA"]
    assert [r["symbol"] for r in H.search_symbols(names, F.lit("ab"), ("x",)).collect()] == ["AB", "ZA"]
    trades = spark.createDataFrame([("s", "A", "bullish", 1.0), ("s", "B", "bullish", -1.0)], "strategy string, ticker string, regime string, net double")
    found = spark.createDataFrame([("s", "A", "bullish"), ("t", "A", "bearish")], "strategy string, ticker string, regime string")
    got = {r["strategy"]: (r["regime_win_rate"], r["ticker_win_rate"], r["sufficient"]) for r in H.with_history(found, trades, least=2).collect()}
    assert got == {"s": (0.5, 1.0, True), "t": (None, None, False)}
    assert [r["ticker"] for r in H.scan(spark.createDataFrame([("A", dt.date(2024, 1, 2), "s", 9.0), ("B", dt.date(2024, 1, 2), "s", 5.0), ("C", dt.date(2024, 1, 1), "s", 7.0)], "ticker string, ts date, strategy string, score double"), ["b"]).collect()] == ["B"]


def test_book_changes_and_orders(spark):
    d = lambda n: dt.date(2024, 1, n)
    trades = spark.createDataFrame([("a", "s", d(1), d(1), d(2)), ("b", "s", d(1), d(1), d(5)), ("c", "s", d(4), d(4), d(9)), ("e", "s", d(4), d(4), d(5)), ("f", "s", d(1), d(1), d(9))], "ticker string, strategy string, signal_ts date, entry_ts date, exit_ts date")
    got = {r["ticker"]: r["change"] for r in K.book_changes(K.book(trades, F.lit(d(3))), K.book(trades, F.lit(d(6)))).collect()}
    assert got == {"b": "closed", "c": "opened", "e": "opened_and_closed", "f": "still_open"}
    found = spark.createDataFrame([("a", 100.0, 95.0), ("b", 3000.0, 2900.0)], "ticker string, entry double, stop double")
    assert [(r["ticker"], r["shares"]) for r in K.order_sizes(found, 10_000.0, 0.01, 1_000.0).collect()] == [("a", 10)]
    held = K.buy_and_hold(daily(spark, [(0, 10, 11, 9, 10, 1), (1, 12, 13, 11, 12, 1)]), 1000.0, 0.0, 0.0).first()
    assert (held["shares"], held["net"], held["total_return"]) == (100, 200.0, 0.2)


def test_sources_round_trip(spark, tmp_path):
    bars = daily(spark, [(0, 1, 2, 1, 1, 1), (1, 2, 3, 2, 2, 1), (2, 3, 3, 2, 2, 1)])
    B.write_bars(bars, str(tmp_path / "bars"))
    assert B.read_bars(spark, str(tmp_path / "bars"), ["A"], "2024-01-02", "2024-01-02", 1).count() == 1
    assert B.read_bars(spark, str(tmp_path / "bars"), ["B"]).count() == 0
    bars.write.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, B.read_csv_bars(spark, str(tmp_path / "csv")).collect())) == sorted(map(tuple, bars.collect()))
    (tmp_path / "A.json").write_text('{"ticker": "A", "candles": [{"timestamp": "2024-01-02T00:00:00Z", "open": 1, "high": 2, "low": 1, "close": 1.5, "volume": 3}], "cachedAt": "2024-01-03T00:00:00Z"}')
    assert [(r["ticker"], r["close"]) for r in B.read_json_cache(spark, str(tmp_path / "A.json")).collect()] == [("A", 1.5)]
    merged = B.merge_pages([bars, bars.withColumn("close", F.lit(9.0))], "2024-01-01", "2024-01-02")
    assert sorted(r["close"] for r in merged.collect()) == [1.0, 2.0]
    built = []
    for _ in range(2):
        B.once(spark, f"test {tmp_path}", lambda: built.append(1) or bars)
    assert len(built) == 1 and B.once(spark, f"test {tmp_path}", lambda: None).count() == 3


def test_formats(spark):
    from barweave.functions import scalars as S

    row = spark.range(1).select(
        S.format_price(F.lit(0.12345)).alias("a"), S.format_price(F.lit(12.345)).alias("b"), S.format_signed_percent(F.lit(1.5)).alias("c"), S.format_compact(F.lit(1234567.0)).alias("d"), S.heat_intensity(F.lit(-2.0)).alias("e"),
        S.in_session_window(F.lit(dt.datetime(2024, 1, 2, 15, 0)), 510, 900).alias("f"), S.in_session_window(F.lit(dt.datetime(2024, 1, 6, 15, 0)), 510, 900).alias("g"),
    ).first()
    assert tuple(row) in {("0.1234", "12.35", "+1.50%", "1.23M", 0.5, True, False), ("0.1235", "12.35", "+1.50%", "1.23M", 0.5, True, False), ("0.1235", "12.34", "+1.50%", "1.23M", 0.5, True, False), ("0.1234", "12.34", "+1.50%", "1.23M", 0.5, True, False)}


def test_locked_queries_have_sql():
    from barweave import plans

    queries, sql = plans.load()
    assert set(sql) <= set(queries) and not {n for n in queries if n.startswith(("backtest", "walk", "param", "excl", "intraday"))} - set(sql)
