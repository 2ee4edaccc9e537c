"""Queries on backtests: walk-forward windows, parameters, exclusions, ledgers, and intraday trades; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import backtest as K
from barweave.operators import intraday as Y
from barweave.operators import metrics as M
from barweave.operators import research as R
from barweave.operators import signals as N
from barweave.operators import strategies as G
from barweave.sources import bars as B

from . import oracle as O
from . import oracle_rules as Q
from .catalogue_bars import cols
from .catalogue_research import _AGG, _rounded
from .catalogue_signals import _INTRADAY, CONTEXT, OUTCOMES, outcomes, outcomes_sql
from .registry import query

CAPITAL = 10_000.0
MOMENTUM = "momentum_continuation"
FLOORS = (15, 20, 25, 30, 35)
_ONLY = f"{CONTEXT}, {Q.signals({MOMENTUM: Q.DAILY[MOMENTUM]}, 'ctx')}, {Q.scored()}"
_DAYS = """cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM bars)), cw AS (SELECT ts, (i - 252) // 126 AS w FROM cal WHERE i >= 252),
wd AS (SELECT ts, w FROM cw WHERE w IN (SELECT w FROM cw GROUP BY w HAVING count(*) = 126))"""


def _momentum(spark, sf):
    """The momentum trades of all tickers."""
    features = N.walk_context(spark, sf)
    return N.trade_outcomes(N.scored_signals(features, {MOMENTUM: G.DAILY[MOMENTUM]}), B.walk(spark, sf))


@query(f"WITH {O.walk()}, {_DAYS} SELECT w::BIGINT AS window, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS end FROM wd GROUP BY w")
def walk_forward_windows(spark, sf):
    rows = K.walk_forward_windows(B.walk(spark, sf))
    return rows.select("window", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start", "end")])


_WINDOWS = f"{outcomes_sql(_ONLY)}, {_DAYS}, wt AS (SELECT oc.*, w FROM oc JOIN wd ON wd.ts = oc.signal_ts)"


def _by_window(spark, sf):
    return M.trade_metrics(K.in_windows(_momentum(spark, sf), K.window_days(B.walk(spark, sf))), "window")


@query(f"{_WINDOWS} SELECT w::BIGINT AS window, {_AGG} FROM wt GROUP BY w")
def walk_forward(spark, sf):
    """The momentum trades of each window of 126 days."""
    return _rounded(_by_window(spark, sf))


@query(
    f"""{_WINDOWS}, wm AS (SELECT w, count(*) FILTER (WHERE net > 0) / count(*)::DOUBLE AS win_rate, CASE WHEN count(*) FILTER (WHERE net < 0) > 0 THEN coalesce(sum(net) FILTER (WHERE net > 0), 0e0) / -sum(net) FILTER (WHERE net < 0)
 WHEN count(*) FILTER (WHERE net > 0) = 0 THEN 0e0 END AS profit_factor FROM wt GROUP BY w), lg AS (SELECT 'win_rate' AS metric, win_rate AS v FROM wm UNION ALL SELECT 'profit_factor', profit_factor FROM wm)
SELECT metric, {O.r6('coalesce(avg(v), 0)', 'mean')}, {O.r6('coalesce(stddev_pop(v), 0)', 'std')}, {O.r6('coalesce(stddev_pop(v) / nullif(abs(avg(v)), 0), 0)', 'cv')} FROM lg GROUP BY metric"""
)
def walk_forward_consistency(spark, sf):
    """Mean, deviation and their ratio of the windows' win rates and finite profit factors."""
    rows = _by_window(spark, sf)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("win_rate", "profit_factor")])
    return _rounded(M.summary(rows.select(F.explode(pairs).alias("x")).select("x.*"), "metric", "value"))


_SWEEP = f"{CONTEXT}, {Q.signals(Q.sweep(FLOORS), 'ctx')}, {Q.scored()}"


@query(f"{outcomes_sql(_SWEEP)} SELECT strategy, {_AGG} FROM oc GROUP BY strategy")
def param_sweep(spark, sf):
    """Momentum at five floors of ADX, judged in one pass."""
    levels = {f"adx_{x}": G.momentum(x, f"adx_{x}") for x in FLOORS}
    trades = N.trade_outcomes(N.scored_signals(N.walk_context(spark, sf), levels), B.walk(spark, sf))
    return _rounded(M.trade_metrics(trades, "strategy"))


@query(
    f"""{outcomes_sql(_ONLY)}, mk AS (SELECT ticker, row_number() OVER (ORDER BY round(sum(net), 6) DESC, ticker) AS place FROM oc GROUP BY ticker)
SELECT left_out::BIGINT AS left_out, {_AGG} FROM oc JOIN mk ON mk.ticker = oc.ticker JOIN (SELECT unnest([0, 1, 3, 5, 10]) AS left_out) n ON place > left_out GROUP BY left_out"""
)
def exclusion_reruns(spark, sf):
    """The momentum trades again without the 1, 3, 5 and 10 tickers that made the most."""
    return _rounded(M.trade_metrics(K.without_best(_momentum(spark, sf)), "left_out"))


@query(
    f"""{OUTCOMES}, dy AS (SELECT strategy, exit_ts, count(*) AS closed, sum(net) AS pnl FROM oc GROUP BY ALL)
SELECT strategy, strftime(exit_ts, '%Y-%m-%d') AS ts, closed, {O.r6('pnl')}, {O.r6(f'{CAPITAL} + sum(pnl) OVER (PARTITION BY strategy ORDER BY exit_ts)', 'equity')} FROM dy"""
)
def backtest_daily(spark, sf):
    """What each strategy's trades made by the day they were closed, and the equity after it."""
    rows = K.ledger(outcomes(spark, sf), "strategy", CAPITAL)
    return _rounded(rows.select("strategy", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "closed", "pnl", "equity"))


# --- intraday ---------------------------------------------------------------------------------------------

#: The market is all symbols' ticks as one series.
_MARKET = """mb AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, arg_min(greatest(value, 0.01), row(ts, event_id)) AS open, arg_max(greatest(value, 0.01), row(ts, event_id)) AS close FROM events GROUP BY 1),
md AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS d FROM mb), ms AS (SELECT ts, close / first(open) OVER (PARTITION BY d ORDER BY ts) - 1 AS market_change FROM md)"""
ISCORED = f"{_INTRADAY}, {Q.signals(Q.INTRADAY, 'ic')}, {_MARKET}, sm AS (SELECT sg.*, market_change FROM sg LEFT JOIN ms ON ms.ts = sg.ts), {Q.scored(Q.INTRADAY_PARTS, 'sm')}"
_MINUTE = "strftime({0}, '%Y-%m-%d %H:%M') AS {0}"
_ICLASS = "CASE WHEN score >= 75 THEN 'BUY' WHEN score >= 50 THEN 'WATCH' ELSE 'AVOID' END"


def _minute(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


def intraday_scored(spark, sf):
    """Context of all bars and the scored signals on them."""
    from barweave.functions import indicators as I

    ticks = B.ticks(spark, sf)
    context = B.once(spark, f"intraday context {sf}", lambda: N.intraday_context(B.intraday_bars(ticks)))
    index = I.opening_range(I.session_vwap(B.intraday_bars(ticks.withColumn("symbol", F.lit("ALL")))))
    return context, Y.add_intraday_score(G.signals(context, G.INTRADAY, keep=Y.SCORE_INPUTS), Y.market_sessions(index))


@query(f"{ISCORED} SELECT ticker, {_MINUTE.format('ts')}, strategy, {cols(*Q.INTRADAY_PARTS, 'score')}, {_ICLASS} AS class FROM sc")
def intraday_scores(spark, sf):
    _, scored = intraday_scored(spark, sf)
    return _rounded(scored.select("ticker", _minute("ts"), "strategy", *Q.INTRADAY_PARTS, "score", "class"))


@query(
    f"""{ISCORED}, f AS (SELECT * FROM sc WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY ny_day, ticker ORDER BY ts, round(score, 6) DESC, strategy) = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY ny_day ORDER BY ts, round(score, 6) DESC, ticker) AS slot FROM f)
SELECT ticker, {_MINUTE.format('ts')}, strategy, slot, {O.r6('score')}, CAST(least(floor(1000e0 / (entry - stop)), floor(10000e0 / entry)) AS BIGINT) AS shares FROM s WHERE slot <= 3"""
)
def scan_cycle(spark, sf):
    """Three orders a day from signals of 50 points and more, a ticker once a day."""
    _, scored = intraday_scored(spark, sf)
    return _rounded(Y.scan_cycle(scored, slots=3, least="WATCH").select("ticker", _minute("ts"), "strategy", "slot", "score", "shares"))


ITRADES = f"""{ISCORED}, lb AS (SELECT ticker, ny_day, max(day_bar) AS last_bar FROM ic GROUP BY ALL),
ie AS (SELECT sc.ticker, strategy, sc.ts AS signal_ts, sc.ny_day, score, e.ts AS entry_ts, e.day_bar AS first_bar, e.open AS first_open, sc.stop + e.open - sc.entry AS stop, sc.target + e.open - sc.entry AS target, e.open * (1 + 5e0 / 1e4) AS paid, last_bar
 FROM sc JOIN ic e ON e.ticker = sc.ticker AND e.ny_day = sc.ny_day AND e.day_bar = sc.day_bar + 1 JOIN lb ON lb.ticker = sc.ticker AND lb.ny_day = sc.ny_day),
im AS (SELECT ie.*, b.ts, b.day_bar, b.open, b.high, b.low, b.close, greatest(stop, 0.98e0 * greatest(first_open, max(b.high) OVER (PARTITION BY ie.ticker, strategy, signal_ts ORDER BY b.day_bar))) AS trail
 FROM ie JOIN ic b ON b.ticker = ie.ticker AND b.ny_day = ie.ny_day AND b.day_bar >= first_bar),
io AS (SELECT *, CASE WHEN low <= trail THEN 'stop' WHEN high >= target THEN 'target' WHEN day_bar = last_bar THEN 'end_of_day' END AS exit_reason, CASE WHEN low <= trail THEN least(open, trail) WHEN high >= target THEN target ELSE close END * (1 - 5e0 / 1e4) AS got FROM im),
it0 AS (SELECT ticker, strategy, signal_ts, ny_day, score, entry_ts, first_bar, day_bar AS exit_bar, ts AS exit_ts, exit_reason, stop, target, paid, got, got - paid AS net, (got - paid) / nullif(paid - stop, 0) AS r_multiple
 FROM io WHERE exit_reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, strategy, signal_ts ORDER BY day_bar) = 1)"""


def intraday_trades(spark, sf):
    context, scored = intraday_scored(spark, sf)
    return context, scored, K.intraday_outcomes(scored.drop("ny_day", "day_bar"), context)


@query(f"{ITRADES} SELECT ticker, strategy, {_MINUTE.format('entry_ts')}, {_MINUTE.format('exit_ts')}, exit_reason, {cols('paid', 'got', 'net', 'r_multiple')} FROM it0")
def backtest_intraday(spark, sf):
    """Each intraday signal traded on its own until its day's end."""
    *_, trades = intraday_trades(spark, sf)
    return _rounded(trades.select("ticker", "strategy", _minute("entry_ts"), _minute("exit_ts"), "exit_reason", "paid", "got", "net", "r_multiple"))


_SHOWN = ("rsi14", "rel_volume12", *Y.CANDIDATES, "market_change", "score", "mfe_r", "mae_r", "minutes_held")
_FEATURES_SQL = f"""{ITRADES}, cb AS (SELECT *, max(CASE WHEN close > open THEN NULL ELSE rn END) OVER (PARTITION BY ticker ORDER BY ts) AS halt, min(ts) OVER (PARTITION BY ticker, ny_day) AS day_start, min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS 11 PRECEDING) AS low12,
 lag(rsi14, 3) OVER (PARTITION BY ticker ORDER BY ts) AS rsi_ago FROM ic),
cf AS (SELECT ticker, ts AS signal_ts, rsi14, rel_volume12, close / vwap - 1 AS vwap_distance, ema9 / ema21 - 1 AS ema_spread, 1 - low12 / close AS above_low, epoch(ts - day_start) / 60 AS minutes_open, least(rn - coalesce(halt, 0), 10)::DOUBLE AS up_bars, rsi14 - rsi_ago AS rsi_change3, atr14 / close AS atr_pct FROM cb),
rn_ AS (SELECT t.ticker, t.strategy, t.signal_ts, max(b.high) AS top, min(b.low) AS bottom FROM it0 t JOIN ic b ON b.ticker = t.ticker AND b.ny_day = t.ny_day AND b.day_bar BETWEEN t.first_bar AND t.exit_bar GROUP BY ALL),
itf AS (SELECT t.*, cf.* EXCLUDE (ticker, signal_ts), market_change, CASE WHEN paid > t.stop THEN (top - paid) / (paid - t.stop) END AS mfe_r, CASE WHEN paid > t.stop THEN (paid - bottom) / (paid - t.stop) END AS mae_r, epoch(exit_ts - entry_ts) / 60 AS minutes_held, net > 0 AS won
 FROM it0 t JOIN cf ON cf.ticker = t.ticker AND cf.signal_ts = t.signal_ts JOIN rn_ ON rn_.ticker = t.ticker AND rn_.strategy = t.strategy AND rn_.signal_ts = t.signal_ts JOIN sc ON sc.ticker = t.ticker AND sc.strategy = t.strategy AND sc.ts = t.signal_ts)"""


def _intraday_features(spark, sf):
    context, scored, trades = intraday_trades(spark, sf)
    return Y.intraday_trade_features(trades, scored, Y.candidate_features(context))


@query(f"{_FEATURES_SQL} SELECT ticker, strategy, {_MINUTE.format('signal_ts')}, won, {cols(*_SHOWN)} FROM itf")
def intraday_trade_features(spark, sf):
    return _rounded(_intraday_features(spark, sf).select("ticker", "strategy", _minute("signal_ts"), "won", *_SHOWN))


_RANKED = ("rsi14", "rel_volume12", *Y.CANDIDATES, "score")
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, 9) AS value, round(r_multiple, 9) AS r_multiple, won FROM itf WHERE {f} IS NOT NULL AND r_multiple IS NOT NULL" for f in _RANKED)


@query(
    f"""{_FEATURES_SQL}, lg AS ({_LONG}), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rx FROM lg),
a AS (SELECT feature, count(*) AS n, (sum(rx) FILTER (WHERE won) - count(*) FILTER (WHERE won) * (count(*) FILTER (WHERE won) + 1) / 2) / nullif(count(*) FILTER (WHERE won) * count(*) FILTER (WHERE NOT won), 0) AS auc FROM k GROUP BY feature)
SELECT feature, n, {O.r6('auc')}, row_number() OVER (ORDER BY round(abs(coalesce(auc, 0.5e0) - 0.5e0), 6) DESC, feature) AS place FROM a"""
)
def auc_ranking(spark, sf):
    """Features of intraday trades by how far their area under the curve lies from a half."""
    features = B.once(spark, f"intraday features {sf}", lambda: _intraday_features(spark, sf), "signal_ts")
    rows = features.withColumns({c: F.round(c, 9) for c in (*_RANKED, "r_multiple")})
    return _rounded(R.by_distance_from_half(R.rank_statistics(rows, "r_multiple", "won", _RANKED)).select("feature", "n", "auc", "place"))
