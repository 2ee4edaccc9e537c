"""Backtests without a portfolio's cash: each signal is a trade of its own, so windows, parameters and exclusions are
joins and groups over trades, and nothing is folded row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import position_size, with_slippage

from .metrics import equity_from_trades


def numbered_days(bars: DataFrame) -> DataFrame:
    """(ts, i): the trading days in order, from 0; one row for each day of the calendar."""
    return bars.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)


def window_days(bars: DataFrame, history: int = 252, size: int = 126) -> DataFrame:
    """(ts, window): days of full windows of ``size`` days one after the other, after ``history`` days."""
    inside = numbered_days(bars).where(F.col("i") >= history).withColumn("window", F.floor((F.col("i") - history) / size))
    full = inside.groupBy("window").count().where(F.col("count") == size).select("window")
    return inside.join(full, "window").select("ts", "window")


def walk_forward_windows(bars: DataFrame, history: int = 252, size: int = 126) -> DataFrame:
    """(window, start, end) of the windows of ``window_days``."""
    return window_days(bars, history, size).groupBy("window").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def in_windows(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Trades with the window of their signal's day; those outside of all windows are left out."""
    return trades.join(days.withColumnRenamed("ts", "signal_ts"), "signal_ts")


def without_best(trades: DataFrame, levels: tuple[int, ...] = (0, 1, 3, 5, 10), net: str = "net") -> DataFrame:
    """Trades for each level n, ``left_out``, without the n tickers that made the most; at most max(levels) names."""
    made = trades.groupBy("ticker").agg(F.round(F.sum(net), 6).alias("_made")).orderBy(F.desc("_made"), "ticker").limit(max(levels))
    best = made.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_made"), "ticker"))).select("ticker", "_rank")
    rows = trades.join(F.broadcast(best), "ticker", "left")  # at most max(levels) rows
    kept = F.filter(F.array(*map(F.lit, levels)), lambda n: F.col("_rank").isNull() | (F.col("_rank") > n))
    return rows.withColumn("left_out", F.explode(kept)).drop("_rank")


def ledger(trades: DataFrame, by: str, capital: float) -> DataFrame:
    """(by, ts, closed, pnl, equity): what the trades that were closed on a day made, and the equity after it."""
    days = trades.groupBy(by, F.col("exit_ts").alias("ts")).agg(F.count("*").alias("closed"))
    return equity_from_trades(trades, by, capital).join(days, [by, "ts"])


def intraday_outcomes(found: DataFrame, bars: DataFrame, trail_pct: float = 0.02, slippage_bps: float = 5.0) -> DataFrame:
    """Each intraday signal traded on its own: in at the day's next open, stop and target moved with it; the stop trails
    the high since the entry, this bar's included; out at the stop, at the target or at the day's last close.

    ``bars``: ticker, ny_day, day_bar and prices. A signal meets the rest of its day by equality on (ticker, ny_day)."""
    prices = bars.select("ticker", "ny_day", "day_bar", "ts", "open", "high", "low", "close")
    last = prices.groupBy("ticker", "ny_day").agg(F.max("day_bar").alias("_last"))
    at = found.join(prices.select("ticker", "ts", "ny_day", "day_bar"), ["ticker", "ts"]).withColumnRenamed("ts", "signal_ts")
    entered = prices.select("ticker", "ny_day", (F.col("day_bar") - 1).alias("day_bar"), F.col("ts").alias("entry_ts"), F.col("open").alias("_open"))
    trades = at.join(entered, ["ticker", "ny_day", "day_bar"]).join(last, ["ticker", "ny_day"])
    shift = F.col("_open") - F.col("entry")
    trades = trades.select(
        "ticker", "strategy", "signal_ts", "entry_ts", "ny_day", "_open", "_last", "score", (F.col("day_bar") + 1).alias("_from"),
        (F.col("stop") + shift).alias("stop"), (F.col("target") + shift).alias("target"), with_slippage(F.col("_open"), slippage_bps, True).alias("paid"),
    )
    key = ("ticker", "strategy", "signal_ts")
    met = trades.join(prices, ["ticker", "ny_day"]).where(F.col("day_bar") >= F.col("_from"))
    since = Window.partitionBy(*key).orderBy("day_bar").rowsBetween(Window.unboundedPreceding, 0)
    trail = F.greatest("stop", F.greatest(F.col("_open"), F.max("high").over(since)) * (1 - trail_pct))
    met = met.withColumn("_trail", trail)
    out = (
        F.when(F.col("low") <= F.col("_trail"), F.struct(F.lit("stop").alias("reason"), F.least("open", "_trail").alias("price")))
        .when(F.col("high") >= F.col("target"), F.struct(F.lit("target").alias("reason"), F.col("target").alias("price")))
        .when(F.col("day_bar") == F.col("_last"), F.struct(F.lit("end_of_day").alias("reason"), F.col("close").alias("price")))
    )
    met = met.withColumn("_out", out).where(F.col("_out").isNotNull())
    by = met.groupBy(*key, "entry_ts", "ny_day", "stop", "target", "paid", "score", "_from").agg(F.min_by(F.struct("ts", "day_bar", "_out"), "day_bar").alias("x"))
    got = with_slippage(F.col("x._out.price"), slippage_bps, False)
    done = by.select(*key, "entry_ts", "ny_day", "stop", "target", "paid", "score", F.col("_from").alias("entry_bar"), F.col("x.day_bar").alias("exit_bar"), F.col("x.ts").alias("exit_ts"), F.col("x._out.reason").alias("exit_reason"), got.alias("got"))
    return done.withColumns({"net": F.col("got") - F.col("paid"), "r_multiple": F.expr("(got - paid) / nullif(paid - stop, 0)")})


def order_sizes(found: DataFrame, capital: float, risk_pct: float, most_per_position: float) -> DataFrame:
    """Signals with the shares of an order: by risk, capped by the money for one position; orders of none are left out."""
    shares = F.least(position_size(F.lit(capital), risk_pct, F.col("entry"), F.col("stop")), F.floor(most_per_position / F.col("entry"))).cast("long")
    return found.withColumn("shares", shares).where("shares > 0")


def buy_and_hold(bars: DataFrame, capital: float, slippage_bps: float = 5.0, commission_bps: float = 2.0) -> DataFrame:
    """Per ticker: whole shares bought at the first open and sold at the last close, with slippage and commission."""
    fee = commission_bps / 1e4
    paid, got = with_slippage(F.min_by("open", "ts"), slippage_bps, True), with_slippage(F.max_by("close", "ts"), slippage_bps, False)
    rows = bars.groupBy("ticker").agg(paid.alias("paid"), got.alias("got")).withColumn("shares", F.floor(capital / (F.col("paid") * (1 + fee))))
    net = F.col("shares") * (F.col("got") - F.col("paid")) - F.col("shares") * (F.col("got") + F.col("paid")) * fee
    return rows.select("ticker", "shares", "paid", "got", net.alias("net"), (net / capital).alias("total_return"))


def book(trades: DataFrame, day) -> DataFrame:
    """The trades that were entered by a day, and whether they were closed by then."""
    return trades.where(F.col("entry_ts") <= day).select("ticker", "strategy", "entry_ts", "signal_ts", (F.col("exit_ts") <= day).alias("closed"))


def book_changes(old: DataFrame, now: DataFrame) -> DataFrame:
    """What changed from one state of the book to a later one: opened, closed, both, or still open; what was closed
    before is left out."""
    key = ["ticker", "strategy", "entry_ts", "signal_ts"]
    rows = now.join(old.withColumnRenamed("closed", "was_closed"), key, "left").where("was_closed is null or not was_closed")
    new = F.col("was_closed").isNull()
    change = F.when(new & F.col("closed"), "opened_and_closed").when(new, "opened").when(F.col("closed"), "closed").otherwise("still_open")
    return rows.select(*key, change.alias("change"))
