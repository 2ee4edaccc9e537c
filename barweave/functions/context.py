"""Multi-timeframe trend, market regime, relative strength: joins on date of causal columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators as I
from .indicators import by_ticker, frame
from .scalars import clamp, div

RS_BARS = 63


def trend_of(close: str, fast: str, slow: str) -> Column:
    c, f, s = F.col(close), F.col(fast), F.col(slow)
    return (
        F.when(f.isNull(), "neutral")
        .when(s.isNotNull(), F.when((c > f) & (f > s), "bullish").when((c < f) & (f < s), "bearish").otherwise("neutral"))
        .when(c > f, "bullish")
        .when(c < f, "bearish")
        .otherwise("neutral")
    )


def add_timeframes(features: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Daily and weekly trend and how far they agree; the running week closes at the row's own close. Weeks come
    from ``bars`` where given, so that the features are not computed twice."""
    week = F.date_trunc("week", "ts").cast("date")
    rows = features.withColumn("week", week)
    daily = (bars if bars is not None else features).withColumn("week", week)
    weeks = daily.groupBy("ticker", "week").agg(F.max_by("close", "ts").alias("week_close"))
    w = I.Window.partitionBy("ticker").orderBy("week")
    past = lambda n: F.when(F.count("week_close").over(w.rowsBetween(-n, -1)) == n, F.sum("week_close").over(w.rowsBetween(-n, -1)))
    sums = weeks.select("ticker", "week", past(49).alias("past49"), past(199).alias("past199"))
    out = rows.join(sums, ["ticker", "week"]).withColumns({"week_sma50": (F.col("past49") + F.col("close")) / 50, "week_sma200": (F.col("past199") + F.col("close")) / 200})
    out = out.withColumns({"daily_trend": trend_of("close", "sma50", "sma200"), "weekly_trend": trend_of("close", "week_sma50", "week_sma200")})
    neutral = (F.col("daily_trend") == "neutral") | (F.col("weekly_trend") == "neutral")
    return out.withColumn("alignment", F.when(neutral, 0.5).when(F.col("daily_trend") == F.col("weekly_trend"), 1.0).otherwise(0.0)).drop("week", "past49", "past199")


def index_regime(bars: DataFrame) -> DataFrame:
    """Per index and date: trend, momentum, drawdown, volatility and the composite."""
    out = I.add_windows(bars)
    trend = F.when(trend_of("close", "sma50", "sma200") == "bullish", 1.0).when(trend_of("close", "sma50", "sma200") == "bearish", -1.0).otherwise(0.0)
    base = F.lag("close", 20).over(by_ticker())
    roc = div(F.col("close") - base, base) * 100
    top = F.max("close").over(frame(-59, 0))
    out = out.withColumns({"trend_score": trend, "momentum_score": F.coalesce(clamp(roc / 10, -1.0, 1.0), F.lit(0.0)), "drawdown": F.coalesce(div(F.col("close") - top, top), F.lit(0.0))})
    composite = 0.5 * F.col("trend_score") + 0.3 * F.col("momentum_score") + 0.2 * clamp(F.col("drawdown") / 0.15, -1.0, 0.0)
    return out.select("ticker", "ts", "trend_score", "momentum_score", "drawdown", F.col("hist_vol20").alias("volatility"), composite.alias("composite"))


def market_regime(indices: DataFrame) -> DataFrame:
    """Per date the regime of all indices that have a bar."""
    rows = index_regime(indices).groupBy("ts").agg(F.avg("composite").alias("regime_score"), F.avg("volatility").alias("regime_volatility"), F.count("*").alias("n_indices"))
    s, v = F.col("regime_score"), F.col("regime_volatility")
    label = F.when(v >= 0.35, "high_volatility").when(s >= 0.6, "strong_bullish").when(s >= 0.25, "bullish").when(s <= -0.6, "strong_bearish").when(s <= -0.25, "bearish").otherwise("neutral")
    return rows.withColumn("regime", label)


def _period_return(n: int) -> Column:
    base = F.lag("close", n).over(by_ticker())
    return div(F.col("close") - base, base)


def relative_strength(bars: DataFrame, benchmark: DataFrame, sectors: DataFrame, sector: Column, n: int = RS_BARS) -> DataFrame:
    """Adds returns over n bars against benchmark and sector, joined on date; the ticker's own and the
    benchmark's missing returns count as 0."""
    own = bars.withColumn("stock_return", F.coalesce(_period_return(n), F.lit(0.0))).withColumn("_sector", sector)
    base = benchmark.select("ts", _period_return(n).alias("benchmark_return"))
    peers = sectors.select(F.col("ticker").alias("_sector"), "ts", _period_return(n).alias("sector_return"))
    out = own.join(base, "ts", "left").join(peers, ["_sector", "ts"], "left").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))
    out = out.withColumns({"vs_benchmark": F.col("stock_return") - F.col("benchmark_return"), "vs_sector": F.col("stock_return") - F.col("sector_return")})
    ahead = F.col("vs_benchmark") > 0
    adjustment = F.when(ahead & (F.col("vs_sector") > 0), 0.15).when(ahead, 0.05).when(F.col("vs_sector").isNull() | (F.col("vs_sector") <= 0), -0.1).otherwise(0.0)
    return out.withColumns({"outperforming_both": ahead & (F.col("vs_sector").isNull() | (F.col("vs_sector") > 0)), "rs_adjustment": adjustment}).drop("_sector")
