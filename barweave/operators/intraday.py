"""Scores of intraday signals, the scan cycle and the features of intraday trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.indicators import by_ticker, frame
from barweave.functions.scalars import clamp01, div, position_size

from .strategies import WEIGHTS, validate_weights

#: What a signal's row needs for its score.
SCORE_INPUTS = ("close", "ema9", "ema21", "vwap", "rsi14", "atr14", "rel_volume12", "session_change", "ny_day", "day_bar")


def market_sessions(index: DataFrame) -> DataFrame:
    """(ts, market_change): the index's change since its session's open at each bar."""
    return index.select("ts", F.col("session_change").alias("market_change"))


def _or_half(known: Column, x: Column) -> Column:
    return F.when(known, x).otherwise(0.5)


def components() -> dict[str, Column]:
    """Seven parts between 0 and 1 from the signal's bar and the market's session; what is not known counts a half."""
    c = F.col
    move = c("market_change")
    regime = F.when(move >= 0.01, 1.0).when(move >= 0.003, 0.75).when(move > -0.003, 0.5).when(move > -0.01, 0.25).otherwise(0.0)
    trend = 0.5 * (c("ema9") > c("ema21")).cast("int") + 0.5 * (c("close") > c("vwap")).cast("int")
    return {
        "trend_part": _or_half(c("ema9").isNotNull() & c("ema21").isNotNull() & c("vwap").isNotNull(), trend),
        "momentum_part": _or_half(c("rsi14").isNotNull(), clamp01((c("rsi14") - 30) / 40)),
        "volume_part": _or_half(c("rel_volume12").isNotNull(), clamp01(c("rel_volume12") / 3)),
        "strength_part": _or_half(c("session_change").isNotNull() & move.isNotNull(), clamp01(0.5 + (c("session_change") - move) / 0.04)),
        "chart_part": clamp01(c("confidence")),
        "regime_part": _or_half(move.isNotNull(), regime),
        "reward_part": F.when(c("risk_reward") > 0, clamp01(c("risk_reward") / 3)).otherwise(0.0),
    }


def add_intraday_score(found: DataFrame, market: DataFrame, weights: dict[str, float] = WEIGHTS, buy: float = 75, watch: float = 50) -> DataFrame:
    """Signals with the weighted parts, the score and the class; ``market`` as ``market_sessions`` gives it, joined on
    time; a signal without a market bar keeps neutral parts."""
    validate_weights(weights)
    parts = components()
    out = found.join(market, "ts", "left").withColumns({k: parts[k] * (weights[k] * 100) for k in parts})
    out = out.withColumn("score", sum((F.col(k) for k in parts), F.lit(0.0)))
    return out.withColumn("class", F.when(F.col("score") >= buy, "BUY").when(F.col("score") >= watch, "WATCH").otherwise("AVOID"))


def scan_cycle(scored: DataFrame, slots: int = 5, least: str = "BUY", equity: float = 100_000.0, risk_pct: float = 0.01, most_per_position: float = 10_000.0) -> DataFrame:
    """The day's choice: at each time the best signals take the slots that are left; a ticker is chosen once a day, at
    its first chosen bar with its best signal; then ``slots`` in order of time and score. Adds the size of the order, by
    risk, capped by the money for one position."""
    allowed = scored.where(F.col("class").isin("BUY", *(["WATCH"] if least == "WATCH" else [])))
    per_ticker = Window.partitionBy("ny_day", "ticker").orderBy("ts", F.desc(F.round("score", 6)), "strategy")
    first = allowed.withColumn("_n", F.row_number().over(per_ticker)).where("_n = 1").drop("_n")
    per_day = Window.partitionBy("ny_day").orderBy("ts", F.desc(F.round("score", 6)), "ticker")
    shares = F.least(position_size(F.lit(equity), risk_pct, F.col("entry"), F.col("stop")), F.floor(most_per_position / F.col("entry"))).cast("long")
    return first.withColumn("slot", F.row_number().over(per_day)).where(F.col("slot") <= slots).withColumn("shares", shares)


def candidate_features(bars: DataFrame) -> DataFrame:
    """Per bar what no strategy reads but research may: distances from VWAP and the recent low, spread of the averages,
    minutes since the open, rising bars in a row (ten at most), change of RSI over three bars."""
    rising = F.col("close") > F.col("open")
    out = bars.withColumn("_stop", F.when(~rising, F.col("rn")))
    last_stop = F.coalesce(F.max("_stop").over(frame(Window.unboundedPreceding, 0)), F.lit(0))
    session = Window.partitionBy("ticker", "ny_day")
    return out.withColumns(
        {
            "vwap_distance": div(F.col("close") - F.col("vwap"), F.col("vwap")),
            "ema_spread": div(F.col("ema9") - F.col("ema21"), F.col("ema21")),
            "above_low": div(F.col("close") - F.min("low").over(frame(-11, 0)), F.col("close")),
            "minutes_open": (F.unix_timestamp("ts") - F.unix_timestamp(F.min("ts").over(session))) / 60.0,
            "up_bars": F.least(F.col("rn") - last_stop, F.lit(10)).cast("double"),
            "rsi_change3": F.col("rsi14") - F.lag("rsi14", 3).over(by_ticker()),
            "atr_pct": div(F.col("atr14"), F.col("close")),
        }
    ).drop("_stop")


CANDIDATES = ("vwap_distance", "ema_spread", "above_low", "minutes_open", "up_bars", "rsi_change3", "atr_pct")


def intraday_trade_features(trades: DataFrame, scored: DataFrame, bars: DataFrame) -> DataFrame:
    """Closed trades with the features of their signal's bar, the parts of its score, the minutes held and how far price
    ran for and against them in multiples of the risk. ``bars`` have the candidate features."""
    at = bars.select("ticker", F.col("ts").alias("signal_ts"), "rsi14", "rel_volume12", *CANDIDATES)
    parts = scored.select("ticker", "strategy", F.col("ts").alias("signal_ts"), "market_change", *components())
    out = trades.join(at, ["ticker", "signal_ts"]).join(parts, ["ticker", "strategy", "signal_ts"])
    prices = bars.select("ticker", "ny_day", "day_bar", "high", "low")
    held = trades.select("ticker", "strategy", "signal_ts", "ny_day", F.explode(F.sequence("entry_bar", "exit_bar")).alias("day_bar")).join(prices, ["ticker", "ny_day", "day_bar"])
    ran = held.groupBy("ticker", "strategy", "signal_ts").agg(F.max("high").alias("_high"), F.min("low").alias("_low"))
    risk = F.col("paid") - F.col("stop")
    return out.join(ran, ["ticker", "strategy", "signal_ts"]).withColumns(
        {
            "won": F.col("net") > 0,
            "minutes_held": (F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts")) / 60.0,
            "mfe_r": F.when(risk > 0, (F.col("_high") - F.col("paid")) / risk),
            "mae_r": F.when(risk > 0, (F.col("paid") - F.col("_low")) / risk),
        }
    ).drop("_high", "_low")
