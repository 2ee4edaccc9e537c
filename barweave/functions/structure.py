"""Swings, structure, levels and the frames that chart patterns read. A swing at row i counts from row i + L on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_ticker, frame
from .scalars import clamp01, div

SWING = 3


def _swing(column: str, high: bool, n: int) -> Column:
    before, after = frame(-n, -1), frame(1, n)
    full = (F.count("ts").over(before) == n) & (F.count("ts").over(after) == n)
    if high:
        best = (F.col(column) > F.max(column).over(before)) & (F.col(column) > F.max(column).over(after))
    else:
        best = (F.col(column) < F.min(column).over(before)) & (F.col(column) < F.min(column).over(after))
    return F.when(full & best, F.col(column))


def add_swings(bars: DataFrame, n: int = SWING) -> DataFrame:
    """Prices of the swings at their own rows (known only n rows later), and of the last two that are known. Where a series
    goes on from a state (``_carried``, see ``resume``), swings that its rows do not show are the state's."""
    past, so_far = frame(Window.unboundedPreceding, -1), frame(Window.unboundedPreceding, 0)
    out = bars.withColumns({"swing_high": _swing("high", True, n), "swing_low": _swing("low", False, n)})
    pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("p"), F.last(c, True).over(past).alias("q")))
    out = out.withColumns({"_h": pair("swing_high"), "_l": pair("swing_low")})
    out = out.withColumns({"_h": F.lag("_h", n).over(by_ticker()), "_l": F.lag("_l", n).over(by_ticker())})
    out = out.withColumns({"_h": F.last("_h", True).over(so_far), "_l": F.last("_l", True).over(so_far)})
    out = out.withColumns({"last_sh": F.col("_h.p"), "prev_sh": F.col("_h.q"), "last_sl": F.col("_l.p"), "prev_sl": F.col("_l.q")})
    if "_carried" in bars.columns:
        held = F.last("_carried", True).over(so_far)["swings"]
        for last, prev in (("last_sh", "prev_sh"), ("last_sl", "prev_sl")):
            earlier = F.when(F.col(last).isNull(), held[prev]).otherwise(held[last])
            out = out.withColumns({prev: F.coalesce(prev, earlier), last: F.coalesce(last, held[last])})
    return out.drop("_h", "_l")


def add_structure(bars: DataFrame, n: int = SWING) -> DataFrame:
    out = add_swings(bars, n)
    trend = (
        F.when(F.col("prev_sh").isNull() | F.col("prev_sl").isNull(), "insufficient_data")
        .when((F.col("last_sh") > F.col("prev_sh")) & (F.col("last_sl") > F.col("prev_sl")), "uptrend")
        .when((F.col("last_sh") < F.col("prev_sh")) & (F.col("last_sl") < F.col("prev_sl")), "downtrend")
        .otherwise("sideways")
    )
    return out.withColumn("trend", trend)


def add_pattern_frames(features: DataFrame) -> DataFrame:
    """On top of the daily features and the structure: levels, ranges, flags, band widths, swings of the last 60 bars."""
    prior, now20, prior15, box = frame(-20, -1), frame(-19, 0), frame(-15, -1), frame(-56, -3)
    impulse, flag, width = frame(-14, -5), frame(-4, 0), frame(-59, 0)
    full = lambda n, x: F.when(F.col("rn") >= n, x)
    point = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("rn").alias("n"), F.col(c).alias("p")))).over(box)
    out = features.withColumns(
        {
            "prev_close": F.lag("close").over(by_ticker()),
            "resistance20": F.max("high").over(prior),
            "support20": F.min("low").over(prior),
            "hi20": full(20, F.max("high").over(now20)),
            "lo20": full(20, F.min("low").over(now20)),
            "hi15p": full(16, F.max("high").over(prior15)),
            "lo15p": full(16, F.min("low").over(prior15)),
            "prev_sma20": F.lag("sma20").over(by_ticker()),
            "prev_sma50": F.lag("sma50").over(by_ticker()),
            "prev_sma200": F.lag("sma200").over(by_ticker()),
            "imp_low": F.lag("low", 14).over(by_ticker()),
            "imp_high": F.lag("high", 14).over(by_ticker()),
            "imp_max": full(15, F.max("high").over(impulse)),
            "imp_min": full(15, F.min("low").over(impulse)),
            "flag_high": F.max("high").over(flag),
            "flag_low": F.min("low").over(flag),
            "imp_volume": F.avg("volume").over(impulse),
            "flag_volume": F.avg("volume").over(flag),
            "width_min": F.when(F.col("bb_width").isNotNull() & (F.count("bb_width").over(width) >= 10), F.min("bb_width").over(width)),
            "width_max": F.max("bb_width").over(width),
            "_highs": point("swing_high"),
            "_lows": point("swing_low"),
        }
    )
    at = lambda c, back: F.get(c, F.size(c) - back)
    between = lambda c, ends: F.get(F.filter(c, lambda x: (x["n"] > at(ends, 2)["n"]) & (x["n"] < at(ends, 1)["n"])), 0)["p"]
    return out.withColumns(
        {"l3": at("_lows", 1)["p"], "l2": at("_lows", 2)["p"], "l1": at("_lows", 3)["p"], "h3": at("_highs", 1)["p"], "h2": at("_highs", 2)["p"], "peak": between("_highs", "_lows"), "trough": between("_lows", "_highs")}
    ).drop("_highs", "_lows")


def add_consolidation(bars: DataFrame, n: int = 20, most: float = 0.08) -> DataFrame:
    """Adds the range of the last n bars (null with fewer), its size against the middle, whether that is at most
    ``most``, and how sure: the tighter the surer, 0 beyond ``most``."""
    full = F.count("ts").over(frame(-(n - 1), 0)) == n
    out = bars.withColumns({"range_high": F.when(full, F.max("high").over(frame(-(n - 1), 0))), "range_low": F.when(full, F.min("low").over(frame(-(n - 1), 0)))})
    out = out.withColumn("range_pct", div(F.col("range_high") - F.col("range_low"), (F.col("range_high") + F.col("range_low")) / 2))
    return out.withColumns({"consolidates": F.coalesce(F.col("range_pct") <= most, F.lit(False)), "consolidation_confidence": F.coalesce(clamp01(1 - F.col("range_pct") / most), F.lit(0.0))})
