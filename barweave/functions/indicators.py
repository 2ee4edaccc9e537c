"""Indicators. Plain windows are Column expressions over (ticker, ts), the recursive ones scans over blocks of bars
(``scans``). All are causal: row i holds what the series up to i gives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .scalars import div


def by_ticker():
    return Window.partitionBy("ticker").orderBy("ts")


def frame(first: int, last: int):
    return by_ticker().rowsBetween(first, last)


def rn() -> Column:
    return F.row_number().over(by_ticker())


def sma(x: str, n: int) -> Column:
    return F.when(rn() >= n, F.avg(x).over(frame(1 - n, 0)))


def sma_nullable(x: str, n: int) -> Column:
    """Null if any of the n values is."""
    return F.when(F.count(x).over(frame(1 - n, 0)) == n, F.avg(x).over(frame(1 - n, 0)))


def roc(n: int = 12) -> Column:
    base = F.lag("close", n).over(by_ticker())
    return div(F.col("close") - base, base) * 100


def relative_volume(n: int = 20) -> Column:
    """Volume over the mean of the n bars before."""
    return F.when(rn() > n, div(F.col("volume"), F.avg("volume").over(frame(-n, -1))))


def obv() -> Column:
    change = F.signum(F.col("close") - F.lag("close").over(by_ticker()))
    return change * F.col("volume")


def add_windows(bars: DataFrame) -> DataFrame:
    """The indicators that plain windows give."""
    out = bars.withColumn("rn", rn())
    one = {f"sma{n}": sma("close", n) for n in (20, 50, 200)}
    std = F.when(rn() >= 20, F.stddev_pop("close").over(frame(-19, 0)))
    low, high = F.min("low").over(frame(-13, 0)), F.max("high").over(frame(-13, 0))
    out = out.withColumns(
        one
        | {
            "bb_std": std,
            "roc12": roc(12),
            "log_return": F.log(div(F.col("close"), F.lag("close").over(by_ticker()))),
            "vol_sma20": sma("volume", 20),
            "rel_volume": relative_volume(20),
            "_signed_volume": obv(),
            "_dollars": F.col("close") * F.col("volume"),
            "_raw_k": F.when(rn() >= 14, F.when(high == low, 50.0).otherwise((F.col("close") - low) / (high - low) * 100)),
        }
    )
    out = out.withColumns(
        {
            "bb_upper": F.col("sma20") + 2 * F.col("bb_std"),
            "bb_lower": F.col("sma20") - 2 * F.col("bb_std"),
            "hist_vol20": F.when(F.col("rn") >= 21, F.stddev_samp("log_return").over(frame(-19, 0)) * np.sqrt(252.0)),
            "obv": F.coalesce(F.sum("_signed_volume").over(frame(Window.unboundedPreceding, 0)), F.lit(0.0)),
            "dollar_volume30": F.when(F.col("rn") >= 30, F.avg("_dollars").over(frame(-29, 0))),
            "stoch_k": sma_nullable("_raw_k", 3),
        }
    )
    out = out.withColumns({"bb_width": div(F.col("bb_upper") - F.col("bb_lower"), F.col("sma20")), "stoch_d": sma_nullable("stoch_k", 3), "volume_spike": F.coalesce(F.col("rel_volume") >= 2.0, F.lit(False))})
    return out.drop("_signed_volume", "_dollars", "_raw_k")


# --- recursive indicators ---------------------------------------------------------------------------------


RECURSIVE = ("ema9", "ema12", "ema21", "ema26", "ema50", "rsi9", "rsi14", "macd", "macd_signal", "macd_hist", "atr14", "plus_di", "minus_di", "adx14")


def _with_moves(bars: DataFrame) -> DataFrame:
    """Numbered bars with what the recursive indicators read; a ticker's first bar has no bar before it."""
    rows = scans.number_bars(bars.drop("rn"), ("close", "high", "low"))
    rows = rows.selectExpr("*", "close - _before_close AS _move", "high - _before_high AS _up", "_before_low - low AS _down")
    moves = (
        "coalesce(greatest(_move, 0D), 0D) AS _gain",
        "coalesce(greatest(-_move, 0D), 0D) AS _loss",
        "CASE WHEN _before_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - _before_close), abs(low - _before_close)) END AS _range",
        "CASE WHEN _up > _down AND _up > 0 THEN _up ELSE 0D END AS _plus",
        "CASE WHEN _down > _up AND _down > 0 THEN _down ELSE 0D END AS _minus",
        "signum(_move) * volume AS _flow",
    )
    return rows.selectExpr(*[f"`{c}`" for c in bars.columns if c != "rn"], "rn", *moves)


def _scans() -> dict[str, scans.Scan]:
    out = {f"ema{n}": scans.ema("close", n) for n in (9, 12, 21, 26, 50)}
    out |= {f"_{side}{n}": scans.wilder_mean(f"_{side}", n, n + 1) for n in (9, 14) for side in ("gain", "loss")}
    out |= {"atr14": scans.wilder_mean("_range", 14, 14)}
    return out | {f"{c}_sum": scans.wilder_sum(c, 14, 15) for c in ("_range", "_plus", "_minus")}


def _rsi(n: int) -> str:
    gain, loss = f"_gain{n}", f"_loss{n}"
    return f"CASE WHEN {loss} = 0 THEN CASE WHEN {gain} = 0 THEN 50D ELSE 100D END ELSE 100 - 100 / (1 + try_divide({gain}, {loss})) END AS rsi{n}"


def _ratio(a: str, b: str) -> str:
    """In per cent, 0 where b is 0."""
    return f"CASE WHEN {b} = 0 THEN 0D ELSE try_divide({a}, {b}) END * 100"


def _recursive_in_block(rows: DataFrame, block: int, halo: int) -> DataFrame:
    """The recursive indicators from the scans; those over other indicators forget within the halo."""
    lines = [f"{_ratio(f'_{side}_sum', '_range_sum')} AS {side}_di" for side in ("plus", "minus")]
    out = rows.selectExpr("*", _rsi(9), _rsi(14), "ema12 - ema26 AS macd", *lines)
    out = out.selectExpr("*", f"{_ratio('abs(plus_di - minus_di)', '(plus_di + minus_di)')} AS _dx")
    second = {"macd_signal": scans.ema("macd", 9, 34), "adx14": scans.wilder_mean("_dx", 14, 28)}
    return scans.scan_in_block(out, second, block, halo).selectExpr("*", "macd - macd_signal AS macd_hist")


def _as_of_each_bar(rows: DataFrame) -> DataFrame:
    """Nulls what a series that ends at the row would not have yet."""
    late = {c: F.when(F.col("rn") >= 29, F.col(c)) for c in ("plus_di", "minus_di", "adx14")}
    return rows.withColumns(late | {"atr14": F.when(F.col("rn") >= 15, F.col("atr14"))})


def _whole_series(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Nulls what a series is too short for."""
    length = bars.groupBy("ticker").agg(F.count("*").alias("_length"))
    out = rows.join(length, "ticker")
    short = {c: F.when(F.col("_length") >= 29, F.col(c)) for c in ("plus_di", "minus_di", "adx14")}
    return out.withColumns(short | {"atr14": F.when(F.col("_length") >= 15, F.col("atr14"))}).drop("_length")


def add_recursive(bars: DataFrame, point_in_time: bool = False, block: int = scans.BLOCK, halo: int = scans.HALO) -> DataFrame:
    """Adds the recursive indicators, by scans over blocks of bars. ``point_in_time`` nulls what a series that ends at the
    row would not have yet. Bars have prices; (ticker, ts) is unique."""
    out = scans.in_blocks(_with_moves(bars), lambda rows: _recursive_in_block(rows, block, halo), _scans(), block, halo)
    out = _as_of_each_bar(out) if point_in_time else _whole_series(out, bars)
    return out.select(*bars.columns, *RECURSIVE)


def features_daily(bars: DataFrame, point_in_time: bool = True, block: int = scans.BLOCK, halo: int = scans.HALO) -> DataFrame:
    """The whole daily snapshot of each bar, in one pass over blocks of bars. ``bars`` may go on from a state
    (``resume``), which is handed on."""

    def make(rows: DataFrame) -> DataFrame:
        recursive = _recursive_in_block(rows, block, halo)
        # Inside of a block, numbers begin anew and running sums lack what came before.
        wide = add_windows(recursive.withColumn("_rn", F.col("rn"))).drop("rn", "obv")
        return wide.withColumnsRenamed({"_rn": "rn", "_obv": "obv"})

    out = scans.in_blocks(_with_moves(bars), make, _all_scans(), block, halo)
    out = _as_of_each_bar(out) if point_in_time else _whole_series(out, bars)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c != "_carried"])


def _all_scans() -> dict[str, scans.Scan]:
    return _scans() | {"_obv": scans.running_sum("_flow")}


def scan_states(bars: DataFrame) -> DataFrame:
    """(ticker, ts, rn, a column per scan): the value of every recurrence at each bar."""
    wanted = _all_scans()
    return scans.in_blocks(_with_moves(bars), lambda rows: rows, wanted).select("ticker", "ts", "rn", *wanted)


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted price since the start of the New York day."""
    day = F.to_date(F.from_utc_timestamp("ts", "America/New_York"))
    w = Window.partitionBy("ticker", "ny_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("ny_day", day).withColumn("vwap", div(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def opening_range(bars: DataFrame, n: int = 3) -> DataFrame:
    """High and low of a New York day's first n bars, once there are so many; the day's first open."""
    day = Window.partitionBy("ticker", "ny_day").orderBy("ts")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("day_bar", F.row_number().over(day))
    early = F.col("day_bar") <= n
    gate = F.col("day_bar") >= n
    return out.withColumns(
        {"or_high": F.when(gate, F.max(F.when(early, F.col("high"))).over(so_far)), "or_low": F.when(gate, F.min(F.when(early, F.col("low"))).over(so_far)), "session_open": F.first("open").over(so_far)}
    ).withColumn("session_change", div(F.col("close") - F.col("session_open"), F.col("session_open")))


def features_intraday(bars: DataFrame) -> DataFrame:
    """The snapshot of intraday bars: only VWAP and the opening range start anew each day."""
    out = opening_range(session_vwap(add_recursive(bars)))
    return out.withColumns({"rn": rn(), "rel_volume12": relative_volume(12), "prior_high20": F.max("high").over(frame(-20, -1)), "vwap_ago": F.lag("vwap", 6).over(by_ticker()), "rsi_before": F.lag("rsi14").over(by_ticker())})
