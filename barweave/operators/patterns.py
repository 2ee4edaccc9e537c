"""Chart patterns as rules: SQL expressions over the wide feature row for hit, confidence and invalidation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def c01(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


@dataclass(frozen=True)
class Pattern:
    """Rules read the feature row. ``hit`` may be null, which counts as false; ``confidence`` holds where it hits, else 0."""

    hit: str
    confidence: str
    invalidation: str
    always: bool = False  # the invalidation also holds without a hit


def _breakout(volume: float) -> Pattern:
    up = "(close - resistance20) / nullif(resistance20, 0)"
    return Pattern(f"close > resistance20 AND rel_volume >= {volume}", f"0.5e0 * {c01(f'{up} / 0.02e0')} + 0.5e0 * {c01(f'rel_volume / {volume * 1.5}e0')}", "resistance20 * 0.98e0")


def _pullback(level: str) -> Pattern:
    away = f"abs(close - {level}) / nullif({level}, 0)"
    return Pattern(f"trend = 'uptrend' AND {away} <= 0.02e0 AND (last_sl IS NULL OR close > last_sl)", c01(f"1 - {away} / 0.02e0"), "last_sl", True)


def _reclaim(ma: str) -> Pattern:
    return Pattern(f"prev_close < prev_{ma} AND close > {ma}", c01(f"(close - {ma}) / nullif({ma}, 0) / 0.02e0"), ma)


def _rejection(ma: str) -> Pattern:
    return Pattern(f"high > {ma} AND close < {ma}", c01("(high - close) / nullif(high, 0) / 0.02e0"), "high")


_BASE = _breakout(1.5)
_TIGHT = "(hi15p - lo15p) / nullif((hi15p + lo15p) / 2, 0)"
_BULL = "(imp_max - imp_low) / nullif(imp_low, 0)"
_BEAR = "(imp_high - imp_min) / nullif(imp_high, 0)"
_FLAG = "coalesce((flag_high - flag_low) / nullif((flag_high + flag_low) / 2, 0), 1e0)"
_DRY = "flag_volume < imp_volume"
_LOWEST, _HIGHEST = "CASE WHEN l2 IS NOT NULL THEN least(l2, l3) END", "CASE WHEN h2 IS NOT NULL THEN greatest(h2, h3) END"
_LOW_GAP, _HIGH_GAP = "abs(l3 - l2) / nullif(l2, 0)", "abs(h3 - h2) / nullif(h2, 0)"
_PEAK, _TROUGH = f"(peak - {_LOWEST}) / nullif({_LOWEST}, 0)", f"({_HIGHEST} - trough) / nullif({_HIGHEST}, 0)"
_WIDTH = "CASE WHEN width_max = width_min THEN 0e0 ELSE (bb_width - width_min) / nullif(width_max - width_min, 0) END"
_TO_SUPPORT, _TO_RESISTANCE = "(low - support20) / nullif(support20, 0)", "(resistance20 - high) / nullif(resistance20, 0)"
_DAY = "CASE WHEN high = low THEN 1e0 ELSE high - low END"

PATTERNS: dict[str, Pattern] = {
    "breakout": _BASE,
    "breakdown": Pattern(
        "close < support20 AND rel_volume >= 1.5", f"0.5e0 * {c01('(support20 - close) / nullif(support20, 0) / 0.02e0')} + 0.5e0 * {c01('rel_volume / 2.25e0')}", "support20 * 1.02e0"
    ),
    "breakout_from_consolidation": Pattern(f"{_TIGHT} <= 0.08e0 AND {_BASE.hit}", f"0.5e0 * {c01(f'1 - {_TIGHT} / 0.08e0')} + 0.5e0 * ({_BASE.confidence})", f"CASE WHEN {_BASE.hit} THEN {_BASE.invalidation} END", True),
    "breakout_with_volume": _breakout(2.0),
    "pullback_to_ema21": _pullback("ema21"),
    "pullback_to_sma50": _pullback("sma50"),
    "sma50_reclaim": _reclaim("sma50"),
    "sma50_rejection": _rejection("sma50"),
    "bull_flag": Pattern(
        f"{_BULL} >= 0.15e0 AND {_FLAG} <= 0.1e0 AND coalesce((imp_max - flag_low) / nullif(imp_max - imp_low, 0), 1e0) <= 0.5e0 AND {_DRY}",
        f"0.4e0 * {c01(f'{_BULL} / 0.225e0')} + 0.3e0 * {c01(f'1 - {_FLAG} / 0.1e0')} + 0.3e0", "flag_low",
    ),
    "bear_flag": Pattern(
        f"{_BEAR} >= 0.15e0 AND {_FLAG} <= 0.1e0 AND coalesce((flag_high - imp_min) / nullif(imp_high - imp_min, 0), 1e0) <= 0.5e0 AND {_DRY}",
        f"0.4e0 * {c01(f'{_BEAR} / 0.225e0')} + 0.3e0 * {c01(f'1 - {_FLAG} / 0.1e0')} + 0.3e0", "flag_high",
    ),
    "double_bottom": Pattern(f"{_LOW_GAP} <= 0.03e0 AND {_PEAK} >= 0.05e0 AND close > peak", f"0.4e0 * {c01(f'1 - {_LOW_GAP} / 0.03e0')} + 0.3e0 * {c01(f'{_PEAK} / 0.1e0')} + 0.3e0", _LOWEST, True),
    "double_top": Pattern(f"{_HIGH_GAP} <= 0.03e0 AND {_TROUGH} >= 0.05e0 AND close < trough", f"0.4e0 * {c01(f'1 - {_HIGH_GAP} / 0.03e0')} + 0.3e0 * {c01(f'{_TROUGH} / 0.1e0')} + 0.3e0", _HIGHEST, True),
    "higher_low_reversal": Pattern("l2 < l1 AND l3 > l2", c01("(l3 - l2) / nullif(l2, 0) / 0.05e0"), "l2"),
    "volatility_contraction": Pattern(f"width_min IS NOT NULL AND {_WIDTH} <= 0.25e0", c01(f"1 - ({_WIDTH}) / 0.25e0"), "CAST(NULL AS DOUBLE)"),
    "support_bounce": Pattern(
        f"{_TO_SUPPORT} <= 0.015e0 AND low >= support20 * 0.97e0 AND close > support20 AND close > open",
        f"0.5e0 * {c01(f'1 - abs({_TO_SUPPORT}) / 0.015e0')} + 0.5e0 * {c01(f'(close - low) / ({_DAY})')}", "support20 * 0.97e0",
    ),
    "resistance_rejection": Pattern(
        f"{_TO_RESISTANCE} <= 0.015e0 AND high <= resistance20 * 1.03e0 AND close < resistance20 AND close < open",
        f"0.5e0 * {c01(f'1 - abs({_TO_RESISTANCE}) / 0.015e0')} + 0.5e0 * {c01(f'(high - close) / ({_DAY})')}", "resistance20 * 1.03e0",
    ),
}


def rule_columns(name: str) -> tuple[str, str, str]:
    """SQL of hit, confidence and invalidation of a pattern."""
    p = PATTERNS[name]
    hit = f"coalesce({p.hit}, false)"
    return hit, f"CASE WHEN {hit} THEN {c01(p.confidence)} ELSE 0e0 END", p.invalidation if p.always else f"CASE WHEN {hit} THEN {p.invalidation} END"


def add_patterns(frames: DataFrame, *names: str) -> DataFrame:
    """Adds <name>, <name>_confidence and <name>_invalidation for each pattern."""
    new = {}
    for name in names or PATTERNS:
        hit, confidence, invalidation = rule_columns(name)
        new |= {name: F.expr(hit), f"{name}_confidence": F.expr(confidence), f"{name}_invalidation": F.expr(invalidation)}
    return frames.withColumns(new)


def patterns_long(frames: DataFrame) -> DataFrame:
    """(ticker, ts, pattern, confidence, invalidation): a row per pattern that hits."""
    rows = []
    for name in PATTERNS:
        hit, confidence, invalidation = rule_columns(name)
        rows.append(F.when(F.expr(hit), F.struct(F.lit(name).alias("pattern"), F.expr(confidence).alias("confidence"), F.expr(invalidation).alias("invalidation"))))
    return frames.select("ticker", "ts", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("ticker", "ts", "x.*")
