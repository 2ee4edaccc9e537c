"""SQL of patterns, strategies and scores for the oracles, written from their definitions in words. Nothing here is taken
from the operators, so a rule that is wrong there turns its query red."""

from __future__ import annotations

from .oracle import r6


def clip(x: str) -> str:
    return f"CASE WHEN ({x}) < 0 THEN 0e0 WHEN ({x}) > 1 THEN 1e0 ELSE ({x}) END"


def _above_resistance(times: str, full: str) -> tuple[str, str]:
    """A close above the highest high of the 20 days before, on so many times the usual volume; half of the confidence
    for the distance (2 % is full), half for the volume (1.5 times the limit is full)."""
    hit = f"rel_volume IS NOT NULL AND rel_volume >= {times} AND resistance20 IS NOT NULL AND close > resistance20"
    return hit, f"{clip('(close / resistance20 - 1) / 0.02e0')} / 2 + {clip(f'rel_volume / {full}')} / 2"


def _near(average: str) -> tuple[str, str]:
    """Within 2 % of an average in an uptrend whose last swing low holds; nearer is surer."""
    distance = f"abs(close - {average}) / {average}"
    return f"trend = 'uptrend' AND {average} IS NOT NULL AND {distance} <= 0.02e0 AND NOT (last_sl IS NOT NULL AND close <= last_sl)", clip(f"1 - {distance} / 0.02e0")


_BREAK = _above_resistance("1.5e0", "2.25e0")
_STRONG = _above_resistance("2e0", "3e0")
_EMA21, _SMA50 = _near("ema21"), _near("sma50")
_BASE = "2 * (hi15p - lo15p) / (hi15p + lo15p)"
_FLAG = "2 * (flag_high - flag_low) / (flag_high + flag_low)"
_QUIET = "flag_volume < imp_volume"
_UP, _DOWN = "(imp_max / imp_low - 1)", "(1 - imp_min / imp_high)"
_LOW2, _HIGH2 = "CASE WHEN l2 < l3 THEN l2 ELSE l3 END", "CASE WHEN h2 > h3 THEN h2 ELSE h3 END"
_RISE, _FALL = f"(peak / ({_LOW2}) - 1)", f"(1 - trough / ({_HIGH2}))"
_PLACE = "CASE WHEN width_max > width_min THEN (bb_width - width_min) / (width_max - width_min) ELSE 0e0 END"
_SPAN = "CASE WHEN high > low THEN high - low ELSE 1e0 END"

#: name → hit, confidence where it hits, invalidation; the invalidation holds with a hit only, but for those in ALWAYS.
PATTERNS = {
    "breakout": (*_BREAK, "resistance20 - resistance20 * 0.02e0"),
    "breakdown": (
        "rel_volume IS NOT NULL AND rel_volume >= 1.5e0 AND support20 IS NOT NULL AND close < support20",
        f"{clip('(1 - close / support20) / 0.02e0')} / 2 + {clip('rel_volume / 2.25e0')} / 2", "support20 + support20 * 0.02e0",
    ),
    "breakout_from_consolidation": (
        f"hi15p IS NOT NULL AND {_BASE} <= 0.08e0 AND {_BREAK[0]}", f"({clip(f'1 - ({_BASE}) / 0.08e0')}) / 2 + ({_BREAK[1]}) / 2",
        f"CASE WHEN {_BREAK[0]} THEN resistance20 - resistance20 * 0.02e0 END",
    ),
    "breakout_with_volume": (*_STRONG, "resistance20 - resistance20 * 0.02e0"),
    "pullback_to_ema21": (*_EMA21, "last_sl"),
    "pullback_to_sma50": (*_SMA50, "last_sl"),
    "sma50_reclaim": ("prev_sma50 IS NOT NULL AND prev_close < prev_sma50 AND close > sma50", clip("(close / sma50 - 1) / 0.02e0"), "sma50"),
    "sma50_rejection": ("high > sma50 AND close < sma50", clip("(1 - close / high) / 0.02e0"), "high"),
    "bull_flag": (
        f"imp_max IS NOT NULL AND {_UP} >= 0.15e0 AND {_FLAG} <= 0.1e0 AND imp_max > imp_low AND imp_max - flag_low <= (imp_max - imp_low) / 2 AND {_QUIET}",
        f"0.3e0 + 0.4e0 * {clip(f'{_UP} / 0.225e0')} + 0.3e0 * {clip(f'1 - ({_FLAG}) / 0.1e0')}", "flag_low",
    ),
    "bear_flag": (
        f"imp_min IS NOT NULL AND {_DOWN} >= 0.15e0 AND {_FLAG} <= 0.1e0 AND imp_high > imp_min AND flag_high - imp_min <= (imp_high - imp_min) / 2 AND {_QUIET}",
        f"0.3e0 + 0.4e0 * {clip(f'{_DOWN} / 0.225e0')} + 0.3e0 * {clip(f'1 - ({_FLAG}) / 0.1e0')}", "flag_high",
    ),
    "double_bottom": (
        f"peak IS NOT NULL AND abs(l3 - l2) / l2 <= 0.03e0 AND {_RISE} >= 0.05e0 AND close > peak",
        f"0.3e0 + 0.4e0 * {clip('1 - abs(l3 - l2) / l2 / 0.03e0')} + 0.3e0 * {clip(f'{_RISE} / 0.1e0')}", f"CASE WHEN l2 IS NOT NULL AND l3 IS NOT NULL THEN {_LOW2} END",
    ),
    "double_top": (
        f"trough IS NOT NULL AND abs(h3 - h2) / h2 <= 0.03e0 AND {_FALL} >= 0.05e0 AND close < trough",
        f"0.3e0 + 0.4e0 * {clip('1 - abs(h3 - h2) / h2 / 0.03e0')} + 0.3e0 * {clip(f'{_FALL} / 0.1e0')}", f"CASE WHEN h2 IS NOT NULL AND h3 IS NOT NULL THEN {_HIGH2} END",
    ),
    "higher_low_reversal": ("l1 IS NOT NULL AND l1 > l2 AND l2 < l3", clip("(l3 / l2 - 1) / 0.05e0"), "l2"),
    "volatility_contraction": (f"width_min IS NOT NULL AND ({_PLACE}) <= 0.25e0", clip(f"1 - 4 * ({_PLACE})"), "CAST(NULL AS DOUBLE)"),
    "support_bounce": (
        "close > open AND close > support20 AND low / support20 - 1 <= 0.015e0 AND low >= support20 - 0.03e0 * support20",
        f"({clip('1 - abs(low / support20 - 1) / 0.015e0')}) / 2 + ({clip(f'(close - low) / ({_SPAN})')}) / 2", "support20 - 0.03e0 * support20",
    ),
    "resistance_rejection": (
        "close < open AND close < resistance20 AND 1 - high / resistance20 <= 0.015e0 AND high <= resistance20 + 0.03e0 * resistance20",
        f"({clip('1 - abs(1 - high / resistance20) / 0.015e0')}) / 2 + ({clip(f'(high - close) / ({_SPAN})')}) / 2", "resistance20 + 0.03e0 * resistance20",
    ),
}
ALWAYS = {"pullback_to_ema21", "pullback_to_sma50", "double_bottom", "double_top", "breakout_from_consolidation"}


def pattern_columns(name: str) -> list[str]:
    hit, confidence, invalidation = PATTERNS[name]
    held = invalidation if name in ALWAYS else f"CASE WHEN {hit} THEN {invalidation} END"
    return [f"coalesce({hit}, false) AS {name}", r6(f"CASE WHEN {hit} THEN {confidence} ELSE 0e0 END", f"{name}_confidence"), r6(f"({held})", f"{name}_invalidation")]


def pattern_rows(name: str) -> str:
    hit, confidence, invalidation = PATTERNS[name]
    return f"SELECT ticker, ts, '{name}' AS pattern, {confidence} AS c, {invalidation} AS i FROM st WHERE {hit}"


def _momentum(floor: float = 25, more: str = "true") -> tuple[str, str, str, str]:
    """A strong, extended uptrend near its high that beats its peers; stop two average ranges below, target 2.5 times
    the risk."""
    setup = (
        f"adx14 IS NOT NULL AND plus_di IS NOT NULL AND minus_di IS NOT NULL AND trend = 'uptrend' AND adx14 >= {floor} AND plus_di > minus_di AND rsi14 BETWEEN 55 AND 85 AND macd_hist > 0"
        f" AND NOT coalesce(rel_volume < 1, false) AND hi20 IS NOT NULL AND 1 - close / hi20 <= 0.08e0 AND outperforming_both AND ({more})"
    )
    return setup, "0.5e0 + 0.5e0 * CASE WHEN adx14 > 40 THEN 1e0 ELSE adx14 / 40 END", "CASE WHEN atr14 IS NULL THEN 0.95e0 * close ELSE close - atr14 - atr14 END", "close + (close - stop) * 2.5e0"


def sweep(floors: tuple[int, ...]) -> dict[str, tuple[str, str, str, str]]:
    return {f"adx_{x}": _momentum(x) for x in floors}


#: name → setup, confidence, stop, target (which may use the stop).
DAILY = {
    "trend_pullback": (
        f"sma200 IS NOT NULL AND sma50 > sma200 AND close > sma50 AND NOT coalesce(rsi14 >= 70, false) AND (({_EMA21[0]}) OR ({_SMA50[0]}))",
        f"CASE WHEN {_EMA21[0]} THEN {_EMA21[1]} ELSE {_SMA50[1]} END",
        "CASE WHEN last_sl IS NOT NULL AND last_sl < close THEN CASE WHEN atr14 IS NULL THEN last_sl - last_sl * 0.01e0 ELSE last_sl - atr14 / 2 END WHEN atr14 IS NULL THEN 0.95e0 * close ELSE close - atr14 - atr14 END",
        "close + (close - stop) * 2",
    ),
    "breakout": (
        PATTERNS["breakout_from_consolidation"][0], PATTERNS["breakout_from_consolidation"][1], "resistance20 - resistance20 * 0.02e0",
        "CASE WHEN resistance20 > lo15p THEN close + resistance20 - lo15p ELSE close + (close - stop) * 2 END",
    ),
    "momentum_continuation": _momentum(),
    "sma_crossover": ("rn >= 201 AND prev_sma50 <= prev_sma200 AND sma50 > sma200", "1e0", "close - close * 0.08e0", "close + (close - stop) * 2"),
    "neutral_quality": _momentum(more="regime IS DISTINCT FROM 'neutral' OR (rsi14 < 68 AND vs_benchmark > 0.1e0)"),
    "bullish_gate": _momentum(more="regime IS DISTINCT FROM 'bullish' OR coalesce(benchmark_roc12, 0e0) > 0"),
}
INTRADAY = {
    "opening_range_breakout": (
        "or_high IS NOT NULL AND close > or_high AND rel_volume12 >= 1.5e0", "0.5e0 + 0.5e0 * CASE WHEN rel_volume12 > 3 THEN 1e0 ELSE rel_volume12 / 3 END",
        "CASE WHEN atr14 IS NOT NULL AND close - atr14 > or_low THEN close - atr14 ELSE or_low END", "close + (close - stop) * 2",
    ),
    "momentum_breakout": (
        "rn > 20 AND ema9 > ema21 AND rsi14 BETWEEN 55 AND 85 AND rel_volume12 >= 2 AND close > prior_high20",
        "0.5e0 * CASE WHEN rel_volume12 > 3 THEN 1e0 ELSE rel_volume12 / 3 END + 0.5e0 * rsi14 / 100", "CASE WHEN atr14 IS NULL THEN close * 0.99e0 ELSE close - atr14 END", "close + (close - stop) * 2",
    ),
    "vwap_trend_continuation": (
        "rn >= 12 AND close > open AND close > vwap AND vwap > vwap_ago AND touched_low IS NOT NULL AND rsi14 > rsi_before AND rsi14 BETWEEN 40 AND 72", "0.5e0 + (rsi14 - 40) / 64",
        "CASE WHEN atr14 IS NOT NULL AND close - atr14 > touched_low THEN close - atr14 ELSE touched_low END", "close + (close - stop) * 2",
    ),
}
#: Texts that stand for a strategy's setup itself.
REASONS = {"trend_pullback": 2, "breakout": 2, "momentum_continuation": 2, "sma_crossover": 1, "neutral_quality": 2, "bullish_gate": 2}


def signals(rules: dict, table: str) -> str:
    """CTE sg: a row per setup whose stop lies below the close."""
    rows = []
    for name, (setup, confidence, stop, target) in rules.items():
        rows.append(f"SELECT * EXCLUDE (stop), '{name}' AS strategy, {confidence} AS confidence, close AS entry, stop, {target} AS target, {REASONS.get(name, 2)} AS n_reasons FROM (SELECT *, {stop} AS stop FROM {table} WHERE {setup}) WHERE stop < close")
    return f"sg AS (SELECT *, (target - entry) / (entry - stop) AS risk_reward FROM ({' UNION ALL '.join(rows)}))"


#: The parts of the score of a daily signal, in points.
PARTS = {
    "trend_part": f"20 * {clip('alignment / 2 + CASE trend WHEN {0}uptrend{0} THEN 0.5e0 WHEN {0}sideways{0} THEN 0.25e0 ELSE 0e0 END'.format(chr(39)))}",
    "momentum_part": f"15 * (0.4e0 * CASE WHEN rsi14 IS NULL THEN 0.5e0 ELSE {clip('(rsi14 - 30) / 40')} END + 0.3e0 * CASE WHEN macd_hist IS NULL THEN 0.5e0 WHEN macd_hist > 0 THEN 1e0 ELSE 0e0 END"
    f" + 0.3e0 * CASE WHEN adx14 IS NULL OR plus_di IS NULL OR minus_di IS NULL THEN 0.5e0 WHEN plus_di <= minus_di THEN 0e0 ELSE {clip('adx14 / 40')} END)",
    "volume_part": f"15 * CASE WHEN rel_volume IS NULL THEN 0.5e0 ELSE {clip('rel_volume / 2')} END",
    "strength_part": f"15 * CASE WHEN rs_adjustment IS NULL THEN 0.5e0 ELSE {clip('4 * (rs_adjustment + 0.1e0)')} END",
    "chart_part": f"20 * {clip('confidence')}",
    "regime_part": "5 * CASE regime WHEN 'strong_bullish' THEN 1e0 WHEN 'bullish' THEN 0.75e0 WHEN 'neutral' THEN 0.5e0 WHEN 'bearish' THEN 0.25e0 WHEN 'high_volatility' THEN 0.3e0 WHEN 'strong_bearish' THEN 0e0 ELSE 0.5e0 END",
    "reward_part": f"10 * CASE WHEN risk_reward > 0 THEN {clip('risk_reward / 3')} ELSE 0e0 END",
}
#: The same of an intraday signal; market_change is that of the whole market in the session.
INTRADAY_PARTS = {
    "trend_part": "20 * CASE WHEN ema9 IS NULL OR ema21 IS NULL OR vwap IS NULL THEN 0.5e0 ELSE (ema9 > ema21)::INT / 2 + (close > vwap)::INT / 2 END",
    "momentum_part": f"15 * CASE WHEN rsi14 IS NULL THEN 0.5e0 ELSE {clip('(rsi14 - 30) / 40')} END",
    "volume_part": f"15 * CASE WHEN rel_volume12 IS NULL THEN 0.5e0 ELSE {clip('rel_volume12 / 3')} END",
    "strength_part": f"15 * CASE WHEN session_change IS NULL OR market_change IS NULL THEN 0.5e0 ELSE {clip('0.5e0 + (session_change - market_change) / 0.04e0')} END",
    "chart_part": f"20 * {clip('confidence')}",
    "regime_part": "5 * CASE WHEN market_change IS NULL THEN 0.5e0 WHEN market_change >= 0.01e0 THEN 1e0 WHEN market_change >= 0.003e0 THEN 0.75e0 WHEN market_change > -0.003e0 THEN 0.5e0 WHEN market_change > -0.01e0 THEN 0.25e0 ELSE 0e0 END",
    "reward_part": f"10 * CASE WHEN risk_reward > 0 THEN {clip('risk_reward / 3')} ELSE 0e0 END",
}


def scored(parts: dict[str, str] = PARTS, source: str = "sg", name: str = "sc") -> str:
    return f"{name}_0 AS (SELECT *, {', '.join(f'{sql} AS {k}' for k, sql in parts.items())} FROM {source}), {name} AS (SELECT *, {' + '.join(parts)} AS score FROM {name}_0)"
