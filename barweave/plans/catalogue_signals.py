"""Queries on structure, patterns, context, strategies and signals; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import context as X
from barweave.functions import indicators as I
from barweave.functions import structure as S
from barweave.functions.scalars import r6
from barweave.operators import patterns as P
from barweave.operators import signals as N
from barweave.operators import strategies as G
from barweave.sources import bars as B

from . import oracle as O
from . import oracle_rules as Q
from .catalogue_bars import KEY, _hours, _RANGE, _VWAP, cols, out
from .registry import query

ST = f"WITH RECURSIVE {O.features()}, {O.structure()}"


def frames(spark, sf):
    """Features, structure and pattern frames, from the feature rows of all queries."""
    return N.walk_context(spark, sf)


@query(f"{ST} SELECT {KEY}, {cols('sh', 'sl')} FROM st WHERE sh IS NOT NULL OR sl IS NOT NULL")
def swings(spark, sf):
    rows = S.add_swings(B.walk(spark, sf)).where("swing_high is not null or swing_low is not null")
    return out(rows.withColumnsRenamed({"swing_high": "sh", "swing_low": "sl"}), "sh", "sl")


@query(f"{ST} SELECT {KEY}, trend, {cols('last_sh', 'prev_sh', 'last_sl', 'prev_sl')} FROM st")
def structure(spark, sf):
    return out(S.add_structure(B.walk(spark, sf)), "trend", "last_sh", "prev_sh", "last_sl", "prev_sl")


@query(f"{ST} SELECT {KEY}, {cols('resistance20', 'support20', 'hi20', 'lo20')}, {O.r6('(hi20 - lo20) / nullif((hi20 + lo20) / 2, 0)', 'range_pct')}, coalesce((hi20 - lo20) / nullif((hi20 + lo20) / 2, 0) <= 0.08e0, false) AS consolidation FROM st")
def support_resistance(spark, sf):
    rows = frames(spark, sf).withColumn("range_pct", F.expr("(hi20 - lo20) / nullif((hi20 + lo20) / 2, 0)")).withColumn("consolidation", F.expr("coalesce(range_pct <= 0.08, false)"))
    return out(rows, "resistance20", "support20", "hi20", "lo20", "range_pct", "consolidation")


_RANGE20 = "CASE WHEN count(*) OVER t = 20 THEN {0} OVER t END"


@query(
    f"""WITH {O.walk()}, r AS (SELECT *, {_RANGE20.format('max(high)')} AS range_high, {_RANGE20.format('min(low)')} AS range_low FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING)),
p AS (SELECT *, 2 * (range_high - range_low) / (range_high + range_low) AS range_pct FROM r)
SELECT {KEY}, {cols('range_high', 'range_low', 'range_pct')}, range_pct IS NOT NULL AND range_pct <= 0.08e0 AS consolidates, {O.r6(f"coalesce({Q.clip('1 - range_pct / 0.08e0')}, 0e0)", 'consolidation_confidence')} FROM p"""
)
def consolidation_range(spark, sf):
    return out(S.add_consolidation(B.walk(spark, sf)), "range_high", "range_low", "range_pct", "consolidates", "consolidation_confidence")


@query(f"WITH {O.walk()}, g AS (SELECT *, (open - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS gap_pct FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)) SELECT {KEY}, {cols('gap_pct')}, CASE WHEN gap_pct >= 0.02e0 THEN 'gap_up' WHEN gap_pct <= -0.02e0 THEN 'gap_down' ELSE 'none' END AS gap FROM g")
def gap(spark, sf):
    rows = B.walk(spark, sf).withColumn("gap_pct", F.try_divide(F.col("open") - F.lag("close").over(I.by_ticker()), F.lag("close").over(I.by_ticker())))
    return out(rows.withColumn("gap", F.when(F.col("gap_pct") >= 0.02, "gap_up").when(F.col("gap_pct") <= -0.02, "gap_down").otherwise("none")), "gap_pct", "gap")


@query(f"{ST} SELECT {KEY}, CASE WHEN trend = 'uptrend' AND last_sl IS NOT NULL THEN close > last_sl WHEN trend = 'downtrend' AND last_sh IS NOT NULL THEN close < last_sh ELSE false END AS continues FROM st")
def trend_continuation(spark, sf):
    rows = S.add_structure(B.walk(spark, sf))
    up, down = (F.col("trend") == "uptrend") & F.col("last_sl").isNotNull(), (F.col("trend") == "downtrend") & F.col("last_sh").isNotNull()
    return out(rows.withColumn("continues", F.when(up, F.col("close") > F.col("last_sl")).when(down, F.col("close") < F.col("last_sh")).otherwise(False)), "continues")


def _patterns(*names: str):
    def run(spark, sf):
        return out(P.add_patterns(frames(spark, sf), *names), *[c for n in names for c in (n, f"{n}_confidence", f"{n}_invalidation")])

    parts = [column for n in names for column in Q.pattern_columns(n)]
    return f"{ST} SELECT {KEY}, {', '.join(parts)} FROM st", run


for _name, _names in {
    "breakout": ("breakout", "breakout_with_volume"),
    "breakdown": ("breakdown",),
    "consolidation": ("breakout_from_consolidation",),
    "pullback": ("pullback_to_ema21", "pullback_to_sma50"),
    "ma_reclaim": ("sma50_reclaim",),
    "ma_rejection": ("sma50_rejection",),
    "flags": ("bull_flag", "bear_flag"),
    "double_formations": ("double_bottom", "double_top"),
    "higher_low_reversal": ("higher_low_reversal",),
    "vol_contraction": ("volatility_contraction",),
    "level_reactions": ("support_bounce", "resistance_rejection"),
}.items():
    _sql, _run = _patterns(*_names)
    query(_sql, name=_name)(_run)


def _long_sql() -> str:
    rows = " UNION ALL ".join(map(Q.pattern_rows, Q.PATTERNS))
    return f"{ST}, l AS ({rows}) SELECT pattern, count(*) AS hits, {O.r6('avg(c)', 'confidence')}, {O.r6('avg(i)', 'invalidation')} FROM l GROUP BY pattern"


@query(_long_sql())
def pattern_summary(spark, sf):
    rows = P.patterns_long(frames(spark, sf)).groupBy("pattern")
    return rows.agg(F.count("*").alias("hits"), r6(F.avg("confidence")).alias("confidence"), r6(F.avg("invalidation")).alias("invalidation"))


def _trend(close: str, fast: str, slow: str) -> str:
    return f"CASE WHEN {fast} IS NULL THEN 'neutral' WHEN {slow} IS NOT NULL THEN CASE WHEN {close} > {fast} AND {fast} > {slow} THEN 'bullish' WHEN {close} < {fast} AND {fast} < {slow} THEN 'bearish' ELSE 'neutral' END WHEN {close} > {fast} THEN 'bullish' WHEN {close} < {fast} THEN 'bearish' ELSE 'neutral' END"


def _timeframes(source: str) -> str:
    f = lambda n: f"CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN sum(wc) OVER (PARTITION BY ticker ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    return f"""wk AS (SELECT ticker, date_trunc('week', ts) AS week, arg_max(close, ts) AS wc FROM {source} GROUP BY 1, 2), ws AS (SELECT ticker, week, {f(49)} AS p49, {f(199)} AS p199 FROM wk),
tf1 AS (SELECT {source}.*, (p49 + close) / 50 AS week_sma50, (p199 + close) / 200 AS week_sma200 FROM {source} JOIN ws ON ws.ticker = {source}.ticker AND ws.week = date_trunc('week', {source}.ts)),
tf2 AS (SELECT *, {_trend('close', 'sma50', 'sma200')} AS daily_trend, {_trend('close', 'week_sma50', 'week_sma200')} AS weekly_trend FROM tf1),
tf AS (SELECT *, CASE WHEN daily_trend = 'neutral' OR weekly_trend = 'neutral' THEN 0.5e0 WHEN daily_trend = weekly_trend THEN 1e0 ELSE 0e0 END AS alignment FROM tf2)"""


@query(f"WITH {O.walk()}, {O.windows()}, {_timeframes('feat')} SELECT {KEY}, daily_trend, weekly_trend, {cols('alignment', 'week_sma50')} FROM tf")
def mtf_alignment(spark, sf):
    return out(X.add_timeframes(I.add_windows(B.walk(spark, sf))), "daily_trend", "weekly_trend", "alignment", "week_sma50")


_INDICES = f"{O.walk('all', 'ixa')}, {O.walk('by_region', 'ixr')}, ix AS (SELECT * FROM ixa UNION ALL SELECT * FROM ixr WHERE ticker IN ('AMERICA', 'ASIA'))"
_REGIME = f"""{_INDICES}, {O.windows('ix', 'ixf')},
ixs AS (SELECT *, CASE {_trend('close', 'sma50', 'sma200')} WHEN 'bullish' THEN 1e0 WHEN 'bearish' THEN -1e0 ELSE 0e0 END AS trend_score,
 coalesce(greatest(-1e0, least(1e0, CASE WHEN lag(close, 20) OVER w IS NULL THEN NULL ELSE (close - lag(close, 20) OVER w) / nullif(lag(close, 20) OVER w, 0) * 100 / 10 END)) * CASE WHEN lag(close, 20) OVER w IS NULL THEN NULL ELSE 1 END, 0e0) AS momentum_score,
 coalesce((close - max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS 59 PRECEDING)) / nullif(max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS 59 PRECEDING), 0), 0e0) AS drawdown FROM ixf WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
ixc AS (SELECT *, 0.5e0 * trend_score + 0.3e0 * momentum_score + 0.2e0 * greatest(-1e0, least(0e0, drawdown / 0.15e0)) AS composite FROM ixs),
rg1 AS (SELECT ts, avg(composite) AS s, avg(hist_vol20) AS v, count(*) AS n_indices FROM ixc GROUP BY ts),
rg AS (SELECT ts, s AS regime_score, v AS regime_volatility, n_indices, CASE WHEN v >= 0.35 THEN 'high_volatility' WHEN s >= 0.6 THEN 'strong_bullish' WHEN s >= 0.25 THEN 'bullish' WHEN s <= -0.6 THEN 'strong_bearish' WHEN s <= -0.25 THEN 'bearish' ELSE 'neutral' END AS regime FROM rg1)"""


@query(f"WITH {_REGIME} SELECT {KEY}, {cols('trend_score', 'momentum_score', 'drawdown', 'composite')}, {O.r6('hist_vol20', 'volatility')} FROM ixc")
def index_regime(spark, sf):
    return out(X.index_regime(B.indices(spark, sf)), "trend_score", "momentum_score", "drawdown", "composite", "volatility")


@query(f"WITH {_REGIME} SELECT strftime(ts, '%Y-%m-%d') AS ts, regime, n_indices, {cols('regime_score', 'regime_volatility')} FROM rg")
def market_regime(spark, sf):
    rows = X.market_regime(B.indices(spark, sf))
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), "regime", "n_indices", *[(r6(c) + F.lit(0.0)).alias(c) for c in ("regime_score", "regime_volatility")])


def _strength(source: str) -> str:
    ret = "(close - lag(close, 63) OVER w) / nullif(lag(close, 63) OVER w, 0)"
    return f"""rs0 AS (SELECT *, coalesce({ret}, 0e0) AS stock_return, list_extract(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], CAST(ascii(ticker) % 5 + 1 AS BIGINT)) AS sector FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
rsb AS (SELECT ts, {ret} AS r, (close - lag(close, 12) OVER w) / nullif(lag(close, 12) OVER w, 0) * 100 AS benchmark_roc12 FROM ixa WINDOW w AS (PARTITION BY ticker ORDER BY ts)), rss AS (SELECT ticker, ts, {ret} AS r FROM ixr WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
rs1 AS (SELECT rs0.*, coalesce(rsb.r, 0e0) AS benchmark_return, benchmark_roc12, rss.r AS sector_return FROM rs0 LEFT JOIN rsb ON rsb.ts = rs0.ts LEFT JOIN rss ON rss.ts = rs0.ts AND rss.ticker = rs0.sector),
rs2 AS (SELECT *, stock_return - benchmark_return AS vs_benchmark, stock_return - sector_return AS vs_sector FROM rs1),
rs AS (SELECT *, vs_benchmark > 0 AND (vs_sector IS NULL OR vs_sector > 0) AS outperforming_both, CASE WHEN vs_benchmark > 0 AND vs_sector > 0 THEN 0.15e0 WHEN vs_benchmark > 0 THEN 0.05e0 WHEN vs_sector IS NULL OR vs_sector <= 0 THEN -0.1e0 ELSE 0e0 END AS rs_adjustment FROM rs2)"""


_RS = ("stock_return", "benchmark_return", "sector_return", "vs_benchmark", "vs_sector")


@query(f"WITH {_INDICES}, {O.walk()}, {_strength('bars')} SELECT {KEY}, {cols(*_RS, 'rs_adjustment')}, outperforming_both FROM rs")
def relative_strength(spark, sf):
    rows = X.relative_strength(B.walk(spark, sf), B.walk(spark, sf, "all"), B.walk(spark, sf, "by_region"), B.sector_of(F.col("ticker")))
    return out(rows, *_RS, "rs_adjustment", "outperforming_both")


CONTEXT = f"WITH RECURSIVE {O.features()}, {O.structure()}, {_timeframes('st')}, {_REGIME}, {_strength('tf')}, ctx AS (SELECT rs.*, rg.regime FROM rs LEFT JOIN rg ON rg.ts = rs.ts)"


_SIGNAL = ("confidence", "entry", "stop", "target", "risk_reward")


def _daily(*names: str):
    def run(spark, sf):
        return out(G.signals(N.walk_context(spark, sf), {n: G.DAILY[n] for n in names}), "strategy", *_SIGNAL)

    return f"{CONTEXT}, {Q.signals({n: Q.DAILY[n] for n in names}, 'ctx')} SELECT {KEY}, strategy, {cols(*_SIGNAL)} FROM sg", run


for _name, _names in {"strat_trend_pullback": ("trend_pullback",), "strat_breakout": ("breakout",), "strat_momentum": ("momentum_continuation",), "strat_sma_cross": ("sma_crossover",), "strat_variants": ("neutral_quality", "bullish_gate")}.items():
    _sql, _run = _daily(*_names)
    query(_sql, name=_name)(_run)

_INTRADAY = f"""WITH RECURSIVE {O.intraday()}, {O.recursive()}, v AS (SELECT * EXCLUDE (atr14), atr14_full AS atr14, {_VWAP.split("SELECT *, ", 1)[1].replace(" FROM bars ", " FROM rec ")}, {_RANGE},
it AS (SELECT *, CASE WHEN rn > 12 THEN volume / nullif(avg(volume) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) END AS rel_volume12, max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high20,
 lag(vwap, 6) OVER w AS vwap_ago, lag(rsi14) OVER w AS rsi_before, CASE WHEN low <= vwap AND (vwap - low) / nullif(vwap, 0) <= 0.003e0 THEN low END AS touch FROM o WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
ic AS (SELECT *, min(touch) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS touched_low FROM it)"""


def _intraday(*names: str):
    def run(spark, sf):
        found = G.signals(N.intraday_context(B.intraday_bars(B.ticks(spark, sf))), {n: G.INTRADAY[n] for n in names})
        return found.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "strategy", *[(r6(c) + F.lit(0.0)).alias(c) for c in _SIGNAL])

    return f"{_INTRADAY}, {Q.signals({n: Q.INTRADAY[n] for n in names}, 'ic')} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, strategy, {cols(*_SIGNAL)} FROM sg", run


for _name, _names in {"strat_orb": ("opening_range_breakout",), "strat_mom_breakout": ("momentum_breakout",), "strat_vwap": ("vwap_trend_continuation",)}.items():
    _sql, _run = _intraday(*_names)
    query(_sql, name=_name)(_run)

_FEATURES_I = ("ema9", "ema21", "rsi14", "atr14", "vwap", "rel_volume12", "session_change")


@query(f"{_INTRADAY} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, {cols(*_FEATURES_I)} FROM ic")
def features_intraday(spark, sf):
    return _hours(N.intraday_context(B.intraday_bars(B.ticks(spark, sf))), _FEATURES_I)


SCORED = f"{CONTEXT}, {Q.signals(Q.DAILY, 'ctx')}, {Q.scored()}"
_CLASS = "CASE WHEN score >= 75 THEN 'BUY' WHEN score >= 50 THEN 'WATCH' ELSE 'AVOID' END AS class"


def scored(spark, sf):
    return N.scored_signals(N.walk_context(spark, sf))


@query(f"{SCORED} SELECT {KEY}, strategy, {cols(*G.COMPONENTS, 'score')}, {_CLASS} FROM sc")
def score_breakdown(spark, sf):
    return out(scored(spark, sf), "strategy", *G.COMPONENTS, "score", "class")


@query(f"{SCORED} SELECT {KEY}, strategy, {cols('score')}, {_CLASS}, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker, strategy) AS rank FROM sc")
def ranked_signals(spark, sf):
    return out(N.ranked(scored(spark, sf)), "strategy", "score", "class", "rank")


@query(f"{SCORED} SELECT {KEY}, strategy, {cols('score')}, {_CLASS} FROM sc QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score DESC, n_reasons DESC, ts DESC, strategy) = 1")
def best_per_ticker(spark, sf):
    return out(N.best_per_ticker(scored(spark, sf)), "strategy", "score", "class")


def outcomes_sql(scored_sql: str) -> str:
    return f"""{scored_sql}, nb AS (SELECT ticker, ts, open, high, low, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n FROM bars),
en AS (SELECT sc.ticker, strategy, sc.ts AS signal_ts, nb.ts AS entry_ts, nb.n AS entry_n, nb.open * (1 + 5e0 / 1e4) AS paid, stop + (nb.open - entry) AS stop, target + (nb.open - entry) AS target, score, regime FROM sc JOIN nb ON nb.ticker = sc.ticker AND nb.n = sc.rn + 1),
mt AS (SELECT en.*, nb.ts, nb.n, CASE WHEN nb.low <= en.stop THEN 'stop' WHEN nb.high >= en.target THEN 'target' END AS reason, CASE WHEN nb.low <= en.stop THEN CASE WHEN nb.open < en.stop THEN nb.open ELSE en.stop END ELSE en.target END AS px, nb.close AS last_close
 FROM en JOIN nb ON nb.ticker = en.ticker AND nb.n >= en.entry_n),
ox AS (SELECT ticker, strategy, signal_ts, entry_ts, entry_n, paid, stop, target, score, regime, arg_min(row(ts, n, reason, px), n) FILTER (WHERE reason IS NOT NULL) AS hit, arg_max(row(ts, n, last_close), n) AS fin FROM mt GROUP BY ALL),
oc0 AS (SELECT * EXCLUDE (hit, fin), CASE WHEN hit IS NULL THEN fin[1] ELSE hit[1] END AS exit_ts, CASE WHEN hit IS NULL THEN fin[2] ELSE hit[2] END AS exit_n, CASE WHEN hit IS NULL THEN 'end_of_data' ELSE hit[3] END AS exit_reason, CASE WHEN hit IS NULL THEN fin[3] ELSE hit[4] END * (1 - 5e0 / 1e4) AS got FROM ox),
oc AS (SELECT *, got - paid AS net, (got - paid) / nullif(paid - stop, 0) AS r_multiple, (got - paid) / nullif(paid, 0) * 100 AS return_pct, exit_n - entry_n + 1 AS bars_held FROM oc0)"""


OUTCOMES = outcomes_sql(SCORED)


def traded(spark, sf):
    return N.trade_outcomes(scored(spark, sf), B.walk(spark, sf))


def outcomes(spark, sf):
    """The trades of all signals, computed once in an application."""
    return B.once(spark, f"trades {sf}", lambda: traded(spark, sf), "signal_ts")


@query(f"{OUTCOMES} SELECT ticker, strftime(signal_ts, '%Y-%m-%d') AS ts, strategy, strftime(exit_ts, '%Y-%m-%d') AS exit_ts, exit_reason, bars_held, {cols('paid', 'got', 'net', 'r_multiple', 'return_pct')} FROM oc")
def trade_outcomes(spark, sf):
    rows = traded(spark, sf).withColumn("ts", F.col("signal_ts")).withColumn("exit_ts", F.date_format("exit_ts", "yyyy-MM-dd"))
    return out(rows, "strategy", "exit_ts", "exit_reason", "bars_held", "paid", "got", "net", "r_multiple", "return_pct")
