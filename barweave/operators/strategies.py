"""Strategies: rules as SQL expressions over the wide feature row; a registry takes further ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import c01, rule_columns


@dataclass(frozen=True)
class Strategy:
    """``stop`` must lie below the close for a setup; ``target`` null means ``multiple`` times the risk."""

    name: str
    setup: str
    confidence: str
    stop: str
    multiple: float = 2.0
    target: str | None = None
    evidence: tuple[tuple[str, str], ...] = ()  # condition, text
    warnings: tuple[tuple[str, str], ...] = ()


def _pullback() -> Strategy:
    (near, near_conf, _), (mid, mid_conf, _) = rule_columns("pullback_to_ema21"), rule_columns("pullback_to_sma50")
    return Strategy(
        "trend_pullback",
        f"close > sma50 AND sma50 > sma200 AND (({near}) OR ({mid})) AND (rsi14 IS NULL OR rsi14 < 70)",
        f"CASE WHEN {near} THEN {near_conf} ELSE {mid_conf} END",
        "CASE WHEN atr14 IS NOT NULL THEN CASE WHEN last_sl < close THEN last_sl - 0.5e0 * atr14 ELSE close - 2 * atr14 END WHEN last_sl < close THEN last_sl * 0.99e0 ELSE close * 0.95e0 END",
        evidence=(("true", "Price above SMA50 and SMA50 above SMA200"), (near, "Pullback to EMA21"), (f"NOT ({near})", "Pullback to SMA50")),
        warnings=(("rel_volume < 0.7", "Below-average volume on the pullback"), ("rsi14 > 60", "RSI is approaching the overbought threshold")),
    )


def _breakout() -> Strategy:
    hit, confidence, stop = rule_columns("breakout_from_consolidation")
    target = "CASE WHEN resistance20 - lo15p > 0 THEN close + (resistance20 - lo15p) ELSE close + 2 * (close - resistance20 * 0.98e0) END"
    return Strategy("breakout", hit, confidence, stop, target=target, evidence=(("true", "Breakout above 20-day resistance"), ("true", "Relative volume confirms the breakout")), warnings=(("hist_vol20 > 0.5", "High volatility"),))


_MOMENTUM = (
    "trend = 'uptrend' AND adx14 >= {adx} AND plus_di > minus_di AND rsi14 >= 55 AND rsi14 <= 85 AND macd_hist > 0 AND (rel_volume IS NULL OR rel_volume >= 1)"
    " AND coalesce((hi20 - close) / nullif(hi20, 0), 1e0) <= 0.08e0 AND outperforming_both"
)


def momentum(min_adx: float = 25, name: str = "momentum_continuation", extra: str = "") -> Strategy:
    return Strategy(
        name, _MOMENTUM.format(adx=min_adx) + extra, "least(1e0, 0.5e0 + 0.5e0 * least(1e0, adx14 / 40))", "CASE WHEN atr14 IS NOT NULL THEN close - 2 * atr14 ELSE close * 0.95e0 END", 2.5,
        evidence=(("true", "Confirmed uptrend structure"), ("true", "ADX and +DI show a strong trend")), warnings=(("true", "No fresh pullback entry"), ("rsi14 > 75", "RSI is extended")),
    )


DAILY: dict[str, Strategy] = {
    s.name: s
    for s in (
        _pullback(),
        _breakout(),
        momentum(),
        Strategy("sma_crossover", "rn >= 201 AND prev_sma50 <= prev_sma200 AND sma50 > sma200", "1e0", "close * 0.92e0", evidence=(("true", "SMA50 crossed above SMA200"),)),
        momentum(name="neutral_quality", extra=" AND (regime IS NULL OR regime <> 'neutral' OR (rsi14 < 68 AND vs_benchmark > 0.10))"),
        momentum(name="bullish_gate", extra=" AND (regime IS NULL OR regime <> 'bullish' OR coalesce(benchmark_roc12 > 0, false))"),
    )
}

INTRADAY: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("opening_range_breakout", "close > or_high AND rel_volume12 >= 1.5", "least(1e0, 0.5e0 + 0.5e0 * least(1e0, rel_volume12 / 3))", "greatest(close - atr14, or_low)"),
        Strategy(
            "momentum_breakout", "rn > 20 AND ema9 > ema21 AND rsi14 >= 55 AND rsi14 <= 85 AND rel_volume12 >= 2 AND close > prior_high20",
            "0.5e0 * least(1e0, rel_volume12 / 3) + 0.5e0 * least(1e0, rsi14 / 100)", "CASE WHEN atr14 IS NOT NULL THEN close - atr14 ELSE close * 0.99e0 END",
        ),
        Strategy(
            "vwap_trend_continuation", "rn >= 12 AND close > vwap AND vwap > vwap_ago AND touched_low IS NOT NULL AND rsi14 > rsi_before AND rsi14 >= 40 AND rsi14 <= 72 AND close > open",
            "0.5e0 + 0.5e0 * (rsi14 - 40) / 32", "greatest(close - atr14, touched_low)",
        ),
    )
}


def register(table: dict[str, Strategy], strategy: Strategy) -> None:
    if strategy.name in table:
        raise ValueError(f"{strategy.name} is registered twice")
    table[strategy.name] = strategy


def signal_sql(s: Strategy) -> dict[str, str]:
    """SQL of a strategy's columns; where there is no setup, all but ``setup`` are null or 0."""
    setup = f"coalesce(({s.setup}) AND ({s.stop}) < close, false)"
    target = s.target or f"close + {s.multiple}e0 * (close - ({s.stop}))"
    return {"setup": setup, "confidence": f"CASE WHEN {setup} THEN {s.confidence} ELSE 0e0 END", "entry": f"CASE WHEN {setup} THEN close END", "stop": f"CASE WHEN {setup} THEN {s.stop} END", "target": f"CASE WHEN {setup} THEN {target} END"}


def signals(features: DataFrame, strategies: dict[str, Strategy], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per ticker, time and strategy with a setup: confidence, entry, stop, target, risk/reward, evidence,
    warnings. All strategies are judged in one pass over the features."""

    def texts(pairs):
        return F.array_compact(F.array(*[F.when(F.expr(f"coalesce({rule}, false)"), F.lit(text)) for rule, text in pairs]).cast("array<string>"))

    rows = []
    for s in strategies.values():
        sql = signal_sql(s)
        fields = [F.lit(s.name).alias("strategy"), *[F.expr(sql[c]).alias(c) for c in ("confidence", "entry", "stop", "target")], texts(s.evidence).alias("evidence"), texts(s.warnings).alias("warnings")]
        rows.append(F.when(F.expr(sql["setup"]), F.struct(*fields)))
    found = features.select("ticker", "ts", *keep, F.explode(F.array_compact(F.array(*rows))).alias("x")).select("ticker", "ts", *keep, "x.*")
    return found.withColumn("risk_reward", F.expr("(target - entry) / nullif(entry - stop, 0)"))


#: The weights of the score's components, in order.
WEIGHTS = {"trend_part": 0.20, "momentum_part": 0.15, "volume_part": 0.15, "strength_part": 0.15, "chart_part": 0.20, "regime_part": 0.05, "reward_part": 0.10}
#: What a market regime is worth.
REGIME_VALUES = {"strong_bullish": 1.0, "bullish": 0.75, "neutral": 0.5, "bearish": 0.25, "strong_bearish": 0.0, "high_volatility": 0.3}


def validate_weights(weights: dict[str, float]) -> None:
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must be at least 0 and add up to 1")


#: Components between 0 and 1, as SQL over the feature row with the signal's columns.
COMPONENTS = {
    "trend_part": c01("0.5e0 * alignment + 0.5e0 * CASE trend WHEN 'uptrend' THEN 1e0 WHEN 'sideways' THEN 0.5e0 ELSE 0e0 END"),
    "momentum_part": c01(
        f"0.4e0 * coalesce({c01('(rsi14 - 30) / 40')} * CASE WHEN rsi14 IS NULL THEN NULL ELSE 1 END, 0.5e0) + 0.3e0 * CASE WHEN macd_hist IS NULL THEN 0.5e0 WHEN macd_hist > 0 THEN 1e0 ELSE 0e0 END"
        f" + 0.3e0 * CASE WHEN adx14 IS NULL OR plus_di IS NULL OR minus_di IS NULL THEN 0.5e0 WHEN plus_di > minus_di THEN {c01('adx14 / 40')} ELSE 0e0 END"
    ),
    "volume_part": f"CASE WHEN rel_volume IS NULL THEN 0.5e0 ELSE {c01('rel_volume / 2')} END",
    "strength_part": f"CASE WHEN rs_adjustment IS NULL THEN 0.5e0 ELSE {c01('(rs_adjustment + 0.1e0) / 0.25e0')} END",
    "chart_part": c01("confidence"),
    "regime_part": "CASE regime " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in REGIME_VALUES.items()) + " ELSE 0.5e0 END",
    "reward_part": f"CASE WHEN risk_reward > 0 THEN {c01('risk_reward / 3')} ELSE 0e0 END",
}
SCORE_INPUTS = ("close", "trend", "alignment", "rsi14", "macd_hist", "adx14", "plus_di", "minus_di", "rel_volume", "rs_adjustment", "regime", "hist_vol20")


def add_score(found: DataFrame, weights: dict[str, float] = WEIGHTS, buy: float = 75, watch: float = 50) -> DataFrame:
    """Adds the weighted components, the score and the class of each signal."""
    validate_weights(weights)
    out = found.withColumns({k: F.expr(sql) * (weights[k] * 100) for k, sql in COMPONENTS.items()})
    out = out.withColumn("score", sum((F.col(k) for k in COMPONENTS), F.lit(0.0)))
    return out.withColumn("class", F.when(F.col("score") >= buy, "BUY").when(F.col("score") >= watch, "WATCH").otherwise("AVOID"))


def add_explanation(scored: DataFrame) -> DataFrame:
    """Adds reasons and risks from the context around a signal."""
    def texts(*pairs):
        return F.array_compact(F.array(*[F.when(F.expr(f"coalesce({rule}, false)"), F.lit(text)) for rule, text in pairs]))

    reasons = F.concat("evidence", texts(("alignment = 1", "Daily and weekly trends agree"), ("regime IN ('bullish', 'strong_bullish')", "Supportive market regime"), ("rs_adjustment > 0", "Outperforming the benchmark")))
    risks = F.concat("warnings", texts(("alignment = 0", "Daily and weekly trends conflict"), ("regime IN ('bearish', 'strong_bearish', 'high_volatility')", "Adverse market regime"), ("rs_adjustment < 0", "Lagging the benchmark"), ("rsi14 > 75", "Overbought"), ("hist_vol20 > 0.6", "High volatility")))
    return scored.withColumns({"reasons": reasons, "risks": risks, "invalidation": F.concat(F.lit("Close below "), F.format_number("stop", 2))})
