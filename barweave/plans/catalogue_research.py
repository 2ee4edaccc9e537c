"""Queries on trades: metrics, research statistics, state comparisons; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions.scalars import r6, session_state
from barweave.operators import backtest as K
from barweave.operators import metrics as M
from barweave.operators import research as R
from barweave.operators import signals as N
from barweave.sources import bars as B
from barweave.streaming import alerts as A
from barweave.streaming import quotes as Z

from . import oracle as O
from .catalogue_bars import cols
from .catalogue_signals import OUTCOMES, SCORED, outcomes, scored
from .registry import query

CAPITAL = 10_000.0
_AGG = """count(net) AS trades, count(*) FILTER (WHERE net > 0) AS wins, count(*) FILTER (WHERE net < 0) AS losses, round(count(*) FILTER (WHERE net > 0) / count(net)::DOUBLE + 1.3e-9, 6) AS win_rate,
 round(coalesce(avg(net) FILTER (WHERE net > 0), 0e0) + 1.3e-9, 6) + 0.0 AS avg_win, round(coalesce(avg(net) FILTER (WHERE net < 0), 0e0) + 1.3e-9, 6) + 0.0 AS avg_loss,
 CASE WHEN count(*) FILTER (WHERE net < 0) > 0 THEN round(coalesce(sum(net) FILTER (WHERE net > 0), 0e0) / -sum(net) FILTER (WHERE net < 0) + 1.3e-9, 6) WHEN count(*) FILTER (WHERE net > 0) = 0 THEN 0e0 END AS profit_factor,
 round(avg(net) + 1.3e-9, 6) + 0.0 AS expectancy, round(max(net) + 1.3e-9, 6) + 0.0 AS best, round(min(net) + 1.3e-9, 6) + 0.0 AS worst"""


def _rounded(df):
    """Six digits; infinite values become null."""
    return df.select(*[(r6(F.when(F.abs(c) < float("inf"), F.col(c))) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


@query(f"{OUTCOMES} SELECT strategy, {_AGG}, round(avg(date_diff('day', entry_ts, exit_ts)) + 1.3e-9, 6) AS holding_days FROM oc GROUP BY strategy")
def metrics(spark, sf):
    trades = outcomes(spark, sf)
    return _rounded(trades.groupBy("strategy").agg(*M.trade_aggregates(), F.avg(F.datediff("exit_ts", "entry_ts")).alias("holding_days")))


def _by(name: str, key_sql: str, key):
    def run(spark, sf):
        return _rounded(M.bucket_metrics(outcomes(spark, sf), {name: key()}))

    return f"{OUTCOMES} SELECT '{name}' AS dimension, {key_sql} AS bucket, {_AGG} FROM oc WHERE {key_sql} IS NOT NULL GROUP BY {key_sql}", run


_SECTOR = "list_extract(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], CAST(ascii(ticker) % 5 + 1 AS BIGINT))"
for _name, _sql, _key in (("by_year", "CAST(year(exit_ts) AS VARCHAR)", lambda: F.year("exit_ts")), ("by_regime", "regime", lambda: F.col("regime")), ("by_sector", _SECTOR, lambda: B.sector_of(F.col("ticker")))):
    _text, _run = _by(_name, _sql, _key)
    query(_text, name=_name)(_run)

_EQUITY = f"""{OUTCOMES}, eq0 AS (SELECT strategy, exit_ts AS ts, sum(net) AS pnl FROM oc GROUP BY ALL), eq1 AS (SELECT *, {CAPITAL} + sum(pnl) OVER (PARTITION BY strategy ORDER BY ts) AS equity FROM eq0),
eq AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY ts) AS peak, equity / nullif(lag(equity) OVER (PARTITION BY strategy ORDER BY ts), 0) - 1 AS r FROM eq1)"""


@query(f"{_EQUITY} SELECT strategy, strftime(ts, '%Y-%m-%d') AS ts, {cols('equity', 'peak')}, {O.r6('(peak - equity) / peak', 'drawdown')} FROM eq")
def drawdown(spark, sf):
    rows = M.drawdown(M.equity_from_trades(outcomes(spark, sf), "strategy", CAPITAL), "strategy")
    return _rounded(rows.select("strategy", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "equity", "peak", "drawdown"))


@query(
    f"""{_EQUITY} SELECT strategy, {O.r6(f'arg_max(equity, ts) / {CAPITAL} - 1', 'total_return')}, {O.r6(f"pow(arg_max(equity, ts) / {CAPITAL}, 1 / greatest(date_diff('day', min(ts), max(ts)) / 365.25e0, 1 / 365.25e0)) - 1", 'cagr')},
 {O.r6('coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 0)', 'sharpe')}, {O.r6('coalesce(avg(r) / nullif(sqrt(avg(pow(least(r, CASE WHEN r IS NOT NULL THEN 0e0 END), 2))), 0) * sqrt(252), 0)', 'sortino')}, {O.r6('max((peak - equity) / peak)', 'max_drawdown')}, {O.r6('coalesce(sqrt(avg(r * r)) * sqrt(252), 0)', 'volatility')} FROM eq GROUP BY strategy"""
)
def equity_metrics(spark, sf):
    return _rounded(M.equity_metrics(M.equity_from_trades(outcomes(spark, sf), "strategy", CAPITAL), "strategy", CAPITAL))


_ORDER = "exit_ts, ticker, signal_ts"


@query(
    f"""{OUTCOMES}, n AS (SELECT *, sign(net) AS s, row_number() OVER (PARTITION BY strategy ORDER BY {_ORDER}) - row_number() OVER (PARTITION BY strategy, sign(net) ORDER BY {_ORDER}) AS g FROM oc),
u AS (SELECT strategy, s, g, count(*) AS c FROM n GROUP BY ALL) SELECT strategy, coalesce(max(c) FILTER (WHERE s = 1), 0) AS longest_wins, coalesce(max(c) FILTER (WHERE s = -1), 0) AS longest_losses FROM u GROUP BY strategy"""
)
def streaks(spark, sf):
    return _rounded(M.streaks(outcomes(spark, sf), "strategy", ("exit_ts", "ticker", "signal_ts")))


@query(
    f"""{OUTCOMES}, t AS (SELECT strategy, ticker, sum(net) AS pnl, avg(net) AS mean FROM oc GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pnl DESC, ticker) AS rank FROM t)
SELECT strategy, count(*) AS tickers, {O.r6('sum(pnl)', 'total')}, {O.r6('coalesce(sum(pnl) FILTER (WHERE rank <= 5) / nullif(sum(pnl), 0) * 100, 0)', 'top5_pct')}, {O.r6('median(pnl)', 'median_pnl')}, count(*) FILTER (WHERE mean > 0) AS positive, count(*) FILTER (WHERE mean < 0) AS negative FROM k GROUP BY strategy"""
)
def concentration(spark, sf):
    return _rounded(M.concentration(outcomes(spark, sf), "strategy"))


_Z = "1.96e0"
_P, _N = "(w / n)", "n"
_MID = f"({_P} + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n)"
_HALF = f"{_Z} * sqrt({_P} * (1 - {_P}) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)"


@query(f"{OUTCOMES}, c AS (SELECT strategy, (count(*) FILTER (WHERE net > 0))::DOUBLE AS w, count(*)::DOUBLE AS n FROM oc GROUP BY strategy) SELECT strategy, {O.r6(f'greatest(0e0, least(1e0, {_MID} - {_HALF}))', 'low')}, {O.r6(f'greatest(0e0, least(1e0, {_MID} + {_HALF}))', 'high')} FROM c")
def wilson(spark, sf):
    rows = outcomes(spark, sf).groupBy("strategy").agg(F.count(F.when(F.col("net") > 0, 1)).cast("double").alias("w"), F.count("*").cast("double").alias("n"))
    low, high = M.wilson(F.col("w"), F.col("n"))
    return _rounded(rows.select("strategy", low.alias("low"), high.alias("high")))


@query(
    f"""{OUTCOMES}, c AS (SELECT strategy, count(*) AS n, count(DISTINCT ticker) AS tickers, count(DISTINCT year(entry_ts)) AS years, count(DISTINCT regime) AS regimes FROM oc GROUP BY strategy),
p AS (SELECT *, (n >= 50)::INT + (tickers >= 15)::INT + (years >= 4)::INT + (regimes >= 3)::INT AS points FROM c)
SELECT strategy, n AS trades, tickers, years, regimes, CASE WHEN n < 20 OR tickers < 5 THEN 'INSUFFICIENT_SAMPLE' WHEN points <= 1 THEN 'WEAK_EVIDENCE' WHEN points <= 3 THEN 'PROMISING' ELSE 'STRONGER_EVIDENCE' END AS evidence FROM p"""
)
def evidence(spark, sf):
    return M.evidence(outcomes(spark, sf), "strategy")


@query(f"{OUTCOMES} SELECT regime AS category, count(*) AS n, {O.r6('avg((net > 0)::INT)', 'win_rate')}, count(*) >= 10 AS sufficient FROM oc WHERE regime IS NOT NULL GROUP BY regime")
def win_rate_by_category(spark, sf):
    return _rounded(R.win_rate_by_category(outcomes(spark, sf), F.col("regime")))


@query(f"{OUTCOMES} SELECT count(*) AS trades, count(*) FILTER (WHERE score IS NULL) AS without_score, count(*) FILTER (WHERE net IS NULL) AS without_outcome, count(*) - count(DISTINCT (ticker, strategy, signal_ts)) AS repeated, (SELECT count(*) FROM sc) - count(*) AS not_entered FROM oc")
def integrity_checks(spark, sf):
    features = N.walk_context(spark, sf)
    found = N.scored_signals(features)
    return R.integrity(outcomes(spark, sf), found)


FEATURES = ("rsi14", "adx14", "rel_volume", "bb_width", "roc12", "hist_vol20", "stoch_k")
_TF = f"{OUTCOMES}, tx AS (SELECT oc.*, {', '.join('ctx.' + f for f in FEATURES)}, net > 0 AS won FROM oc JOIN ctx ON ctx.ticker = oc.ticker AND ctx.ts = oc.signal_ts)"
_LONG = f"{_TF}, lg AS ({' UNION ALL '.join(f'SELECT strategy, ticker, signal_ts, won, return_pct, {chr(39)}{f}{chr(39)} AS feature, {f} AS value FROM tx WHERE {f} IS NOT NULL' for f in FEATURES)})"


def featured(spark, sf):
    features = N.walk_context(spark, sf)
    trades = outcomes(spark, sf)
    return R.trade_features(trades, features, *FEATURES).withColumn("won", F.col("net") > 0)


@query(f"{_TF} SELECT ticker, strategy, strftime(signal_ts, '%Y-%m-%d') AS ts, won, {cols(*FEATURES, 'return_pct')} FROM tx")
def trade_features(spark, sf):
    return _rounded(featured(spark, sf).select("ticker", "strategy", F.date_format("signal_ts", "yyyy-MM-dd").alias("ts"), "won", *FEATURES, "return_pct"))


@query(
    f"""{_LONG}, g AS (SELECT feature, count(*) FILTER (WHERE won) AS n_yes, count(*) FILTER (WHERE NOT won) AS n_no, avg(value) FILTER (WHERE won) AS mean_yes, avg(value) FILTER (WHERE NOT won) AS mean_no, median(value) FILTER (WHERE won) AS median_yes, median(value) FILTER (WHERE NOT won) AS median_no,
 stddev_pop(value) FILTER (WHERE won) AS std_yes, stddev_pop(value) FILTER (WHERE NOT won) AS std_no, var_samp(value) FILTER (WHERE won) AS v1, var_samp(value) FILTER (WHERE NOT won) AS v0 FROM lg GROUP BY feature),
d AS (SELECT *, (mean_yes - mean_no) / nullif(sqrt(((n_yes - 1) * v1 + (n_no - 1) * v0) / nullif(n_yes + n_no - 2, 0)), 0) AS cohens_d FROM g)
SELECT feature, n_yes, n_no, {cols('mean_yes', 'mean_no', 'median_yes', 'median_no', 'std_yes', 'std_no', 'cohens_d')}, CASE WHEN n_yes < 10 OR n_no < 10 OR cohens_d IS NULL THEN 'insufficient' WHEN abs(cohens_d) < 0.2 THEN 'noise' WHEN abs(cohens_d) < 0.5 THEN 'weak' ELSE 'interesting' END AS effect FROM d"""
)
def cohens_d(spark, sf):
    return _rounded(R.compare_groups(featured(spark, sf), "won", FEATURES))


@query(
    f"""{_LONG}, rd AS (SELECT feature, won, round(value, 9) AS value, round(return_pct, 9) AS return_pct FROM lg), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY return_pct) + (count(*) OVER (PARTITION BY feature, return_pct) - 1) / 2 AS ry FROM rd)
SELECT feature, count(*) AS n, {O.r6('corr(rx, ry)', 'spearman')}, {O.r6('(sum(rx) FILTER (WHERE won) - count(*) FILTER (WHERE won) * (count(*) FILTER (WHERE won) + 1) / 2) / nullif(count(*) FILTER (WHERE won) * count(*) FILTER (WHERE NOT won), 0)', 'auc')} FROM k GROUP BY feature"""
)
def rank_statistics(spark, sf):
    rows = featured(spark, sf).withColumns({c: F.round(c, 9) for c in (*FEATURES, "return_pct")})  # equal but for the last bit is a tie
    return _rounded(R.rank_statistics(rows, "return_pct", "won", FEATURES))


@query(
    f"""{_TF}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY strategy ORDER BY rsi14, ticker, signal_ts) - 1) / ceil(count(*) OVER (PARTITION BY strategy) / 10.0)) + 1 AS BIGINT) AS decile FROM tx)
SELECT strategy, decile, count(*) AS n, {O.r6('avg(rsi14)', 'rsi14')}, {O.r6('avg(return_pct)', 'return_pct')} FROM b GROUP BY ALL"""
)
def ceil_deciles(spark, sf):
    rows = R.ceil_deciles(featured(spark, sf), ("strategy",), "rsi14", ("ticker", "signal_ts"))
    return _rounded(rows.groupBy("strategy", "decile").agg(F.count("*").alias("n"), F.avg("rsi14").alias("rsi14"), F.avg("return_pct").alias("return_pct")))


_SCORE = "round(score, 6)"
_DEC = f"""{OUTCOMES}, nt AS (SELECT *, ntile(10) OVER (PARTITION BY strategy ORDER BY {_SCORE}, ticker, signal_ts) AS decile FROM oc), dc0 AS (SELECT strategy, decile, count(*) AS n, avg((net > 0)::INT) AS win_rate, avg(net) AS mean FROM nt GROUP BY ALL),
dc AS (SELECT s.strategy, d.decile, coalesce(n, 0) AS n, win_rate, mean FROM (SELECT DISTINCT strategy FROM oc) s CROSS JOIN (SELECT range AS decile FROM range(1, 11)) d LEFT JOIN dc0 ON dc0.strategy = s.strategy AND dc0.decile = d.decile)"""


def _deciles(spark, sf):
    return R.score_deciles(outcomes(spark, sf).withColumn("score", F.round("score", 6)), "strategy", "score", ("ticker", "signal_ts"))


@query(f"{_DEC} SELECT strategy, decile, n, {cols('win_rate', 'mean')} FROM dc")
def score_deciles(spark, sf):
    return _rounded(_deciles(spark, sf))


@query(f"{_DEC}, f AS (SELECT *, mean < lag(mean) OVER (PARTITION BY strategy ORDER BY decile) AS falls FROM dc WHERE mean IS NOT NULL) SELECT strategy, count(*) FILTER (WHERE falls) AS decreases, coalesce(string_agg(CAST(decile AS VARCHAR), ',' ORDER BY decile) FILTER (WHERE falls), '') AS at FROM f GROUP BY strategy")
def monotonicity(spark, sf):
    return _rounded(R.monotonicity(_deciles(spark, sf), "strategy", "mean"))


@query(f"{OUTCOMES} SELECT strategy, threshold, count(*) AS n, {O.r6('avg((net > 0)::INT)', 'win_rate')}, {O.r6('avg(net)', 'mean')} FROM oc JOIN (SELECT unnest([40e0, 50e0, 60e0, 70e0, 80e0]) AS threshold) t ON {_SCORE} >= threshold GROUP BY ALL")
def thresholds(spark, sf):
    return _rounded(R.thresholds(outcomes(spark, sf).withColumn("score", F.round("score", 6)), "strategy", "score", (40, 50, 60, 70, 80)))


@query(
    f"""{OUTCOMES} SELECT oc.ticker, strategy, strftime(signal_ts, '%Y-%m-%d') AS ts, {O.r6('(max(nb.high) / any_value(paid) - 1) * 100', 'mfe_pct')}, {O.r6('(min(nb.low) / any_value(paid) - 1) * 100', 'mae_pct')},
 CASE WHEN max(nb.high) IS NULL THEN NULL WHEN (max(nb.high) - any_value(paid)) / nullif(any_value(paid) - any_value(stop), 0) < 0.3 THEN 'never_worked' WHEN (max(nb.high) - any_value(paid)) / nullif(any_value(paid) - any_value(stop), 0) >= 0.7 THEN 'reversed' ELSE 'middle' END AS outcome
 FROM oc JOIN nb ON nb.ticker = oc.ticker AND nb.n BETWEEN entry_n AND exit_n GROUP BY oc.ticker, strategy, signal_ts"""
)
def mfe_mae(spark, sf):
    rows = R.excursions(outcomes(spark, sf), B.walk(spark, sf))
    return _rounded(rows.select("ticker", "strategy", F.date_format("signal_ts", "yyyy-MM-dd").alias("ts"), "mfe_pct", "mae_pct", R.excursion_label(F.col("mfe_r")).alias("outcome")))


@query(
    f"""{OUTCOMES}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY signal_ts, ticker) <= floor(count(*) OVER (PARTITION BY strategy) / 2.0) THEN 1 ELSE 2 END AS half FROM oc)
SELECT strategy, half::BIGINT AS half, {_AGG} FROM h GROUP BY ALL"""
)
def temporal_split(spark, sf):
    return _rounded(M.trade_metrics(R.temporal_split(outcomes(spark, sf), "strategy", ("signal_ts", "ticker")), "strategy", "half"))


_CUT = "DATE '1997-01-01'"


@query(
    f"""{OUTCOMES}, now AS (SELECT ticker, strategy, entry_ts, signal_ts, exit_ts <= {_CUT} + 90 AS closed FROM oc WHERE entry_ts <= {_CUT} + 90), old AS (SELECT ticker, strategy, entry_ts, signal_ts, exit_ts <= {_CUT} AS closed FROM oc WHERE entry_ts <= {_CUT})
SELECT now.ticker, now.strategy, strftime(now.signal_ts, '%Y-%m-%d') AS ts, CASE WHEN old.ticker IS NULL AND now.closed THEN 'opened_and_closed' WHEN old.ticker IS NULL THEN 'opened' WHEN now.closed AND NOT old.closed THEN 'closed' ELSE 'still_open' END AS change
FROM now LEFT JOIN old ON old.ticker = now.ticker AND old.strategy = now.strategy AND old.entry_ts = now.entry_ts AND old.signal_ts = now.signal_ts WHERE old.ticker IS NULL OR NOT old.closed"""
)
def trade_diff(spark, sf):
    """Two states of the book, 90 days apart: what opened, closed and is still open."""
    trades = outcomes(spark, sf)
    cut = F.to_date(F.lit("1997-01-01"))
    rows = K.book_changes(K.book(trades, cut), K.book(trades, F.date_add(cut, 90)))
    return rows.select("ticker", "strategy", F.date_format("signal_ts", "yyyy-MM-dd").alias("ts"), "change")


_FEE = "2e0 / 1e4"


@query(
    f"""WITH {O.walk()}, e AS (SELECT ticker, arg_min(open, ts) * (1 + 5e0 / 1e4) AS paid, arg_max(close, ts) * (1 - 5e0 / 1e4) AS got, min(ts) AS a, max(ts) AS b FROM bars GROUP BY ticker),
s AS (SELECT *, floor({CAPITAL} / (paid * (1 + {_FEE}))) AS shares FROM e)
SELECT ticker, shares::BIGINT AS shares, {cols('paid', 'got')}, {O.r6(f'shares * (got - paid) - shares * (got + paid) * {_FEE}', 'net')}, {O.r6(f'(shares * (got - paid) - shares * (got + paid) * {_FEE}) / {CAPITAL}', 'total_return')} FROM s"""
)
def buy_and_hold(spark, sf):
    return _rounded(K.buy_and_hold(B.walk(spark, sf), CAPITAL))


# --- quotes and alerts ------------------------------------------------------------------------------------

_PX = "greatest(value, 0.01)"


@query(f"SELECT event_type AS symbol, round(arg_max({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS price, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS ticks FROM events GROUP BY 1")
def latest_quote(spark, sf):
    return Z.latest_quote(B.ticks(spark, sf)).select("symbol", r6("price").alias("price"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "ticks")


_ALERTS = f"(SELECT event_type || '_' || side AS alert_id, event_type AS symbol, side, round(avg({_PX}), 6) * CASE side WHEN 'price_above' THEN 4e0 ELSE 0.02e0 END AS threshold FROM events, (SELECT unnest(['price_above', 'price_below']) AS side) GROUP BY event_type, side)"


@query(
    f"""WITH a AS {_ALERTS} SELECT alert_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, round(arg_min({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS price FROM a JOIN events ON event_type = symbol AND CASE side WHEN 'price_above' THEN {_PX} >= threshold ELSE {_PX} <= threshold END GROUP BY alert_id"""
)
def alert_hits(spark, sf):
    """Alerts at four times and a fiftieth of a symbol's mean price; each fires once, at the first tick that meets it."""
    rows = B.ticks(spark, sf)
    mean = F.round(F.avg("price"), 6)
    levels = rows.groupBy("symbol").agg((mean * 4.0).alias("price_above"), (mean * 0.02).alias("price_below"))
    sides = F.array(*[F.struct(F.lit(s).alias("condition"), F.col(s).alias("threshold")) for s in ("price_above", "price_below")])
    alerts = levels.select("symbol", F.explode(sides).alias("x")).select(F.concat_ws("_", "symbol", "x.condition").alias("alert_id"), "symbol", "x.*")
    return A.alert_hits(rows, alerts).select("alert_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r6("price").alias("price"))


_LADDER = f"""(SELECT DISTINCT event_type AS symbol, condition, round({_PX}, 1) AS threshold FROM events, (SELECT unnest(['price_above', 'price_below']) AS condition))"""


@query(
    f"""WITH a AS {_LADDER}, t AS (SELECT event_type AS symbol, ts, event_id, {_PX} AS price FROM events)
SELECT a.symbol, condition, threshold, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(event_id, row(ts, event_id)) AS event_id, round(arg_min(price, row(ts, event_id)) + 1.3e-9, 6) AS price
FROM a JOIN t ON t.symbol = a.symbol AND CASE condition WHEN 'price_above' THEN price >= threshold ELSE price <= threshold END GROUP BY a.symbol, condition, threshold"""
)
def alert_ladder(spark, sf):
    """An alert above and below at every tenth that a symbol's price was near: thousands of alerts a symbol."""
    rows = B.ticks(spark, sf)
    kinds = F.explode(F.array(F.lit("price_above"), F.lit("price_below"))).alias("condition")
    alerts = rows.select("symbol", F.round("price", 1).alias("threshold"), kinds).distinct()
    hits = A.first_hits(rows, alerts.withColumn("alert_id", F.concat_ws("_", "symbol", "condition", "threshold")))
    return hits.select("symbol", "condition", "threshold", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id", r6("price").alias("price"))


@query(
    f"""WITH q AS (SELECT event_type AS symbol, ts, event_id, {_PX} AS price, lag({_PX}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, round(price + 1.3e-9, 6) AS price FROM q WHERE before IS NULL OR price <> before"""
)
def quote_changes(spark, sf):
    """The ticks that change a symbol's price."""
    return Z.changes(B.ticks(spark, sf)).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id", r6("price").alias("price"))


_NYT = "timezone('America/New_York', timezone('UTC', ts))"


@query(f"SELECT CASE WHEN isodow({_NYT}) > 5 THEN 'closed' WHEN m BETWEEN 240 AND 569 THEN 'pre' WHEN m BETWEEN 570 AND 959 THEN 'open' WHEN m BETWEEN 960 AND 1199 THEN 'post' ELSE 'closed' END AS state, count(*) AS ticks FROM (SELECT ts, hour({_NYT}) * 60 + minute({_NYT}) AS m FROM events) GROUP BY 1")
def session_states(spark, sf):
    return B.ticks(spark, sf).groupBy(session_state(F.col("ts")).alias("state")).agg(F.count("*").alias("ticks"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS hour, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1")
def window_limiter(spark, sf):
    """Fixed-window counts per client that are over the limit."""
    rows = B.ticks(spark, sf).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("requests")).where("requests > 1")
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "requests")


@query(f"SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({_PX} + 1.3e-9, 6) AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1")
def first_tick_per_time(spark, sf):
    """Of ticks of one time, the first by id stays."""
    rows = B.first_per_timestamp(B.ticks(spark, sf).withColumnRenamed("symbol", "ticker"), F.col("event_id"))
    return rows.select(F.col("ticker").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r6("price").alias("price"))


@query(
    f"""WITH q AS (SELECT event_type AS symbol, arg_max({_PX}, row(ts, event_id)) AS price, max(ts) AS ts FROM events GROUP BY 1), f AS (SELECT * FROM q WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)
SELECT q.symbol, round(q.price + 1.3e-9, 6) AS price, f.symbol IS NULL AS stale FROM q LEFT JOIN f ON f.symbol = q.symbol"""
)
def quotes_with_stale(spark, sf):
    """The last quote of each symbol; stale if it is over ten minutes older than the newest tick of all."""
    rows = B.ticks(spark, sf)
    known = Z.latest_quote(rows)
    newest = rows.agg(F.max("ts").alias("_now"))  # one row
    fresh = known.join(F.broadcast(newest), F.col("ts") >= F.col("_now") - F.expr("interval 10 minutes"))
    return Z.with_stale(fresh, known).select("symbol", r6("price").alias("price"), "stale")


@query(f"WITH {O.walk('by_supplier')}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM bars), s AS (SELECT ticker, avg(volume) FILTER (WHERE back <= 30) AS avg_volume FROM x GROUP BY ticker) SELECT ticker, round(avg_volume + 1.3e-9, 6) AS avg_volume FROM s WHERE avg_volume > 0 ORDER BY avg_volume DESC, ticker LIMIT 500")
def liquidity_universe(spark, sf):
    """The 500 tickers with the highest volume over 30 bars."""
    from barweave.operators.quality import top_by_liquidity

    return _rounded(top_by_liquidity(B.walk(spark, sf, "by_supplier")))


@query(f"{SCORED} SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strategy, least(floor(10000e0 * 0.01 / (entry - stop)), floor(2000e0 / entry))::BIGINT AS shares FROM sc WHERE least(floor(10000e0 * 0.01 / (entry - stop)), floor(2000e0 / entry)) > 0")
def order_sizing(spark, sf):
    """Shares by risk, capped by the money for one position; orders of no share are skipped."""
    rows = K.order_sizes(scored(spark, sf), 10_000.0, 0.01, 2_000.0)
    return rows.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "strategy", "shares")


@query(
    f"""{SCORED} SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strategy,
 concat_ws('; ', CASE WHEN alignment = 1 THEN 'Daily and weekly trends agree' END, CASE WHEN regime IN ('bullish', 'strong_bullish') THEN 'Supportive market regime' END, CASE WHEN rs_adjustment > 0 THEN 'Outperforming the benchmark' END) AS context_reasons,
 concat_ws('; ', CASE WHEN alignment = 0 THEN 'Daily and weekly trends conflict' END, CASE WHEN regime IN ('bearish', 'strong_bearish', 'high_volatility') THEN 'Adverse market regime' END, CASE WHEN rs_adjustment < 0 THEN 'Lagging the benchmark' END,
  CASE WHEN rsi14 > 75 THEN 'Overbought' END, CASE WHEN hist_vol20 > 0.6 THEN 'High volatility' END) AS context_risks, 'Close below ' || format('{{:,.2f}}', stop) AS invalidation FROM sc"""
)
def explanations(spark, sf):
    """The reasons and risks that the context adds to each signal, and what would invalidate it, as texts."""
    from barweave.operators.strategies import add_explanation

    rows = add_explanation(scored(spark, sf))
    added = lambda texts, own: F.array_join(F.expr(f"slice({texts}, size({own}) + 1, size({texts}))"), "; ")
    reasons, risks = added("reasons", "evidence").alias("context_reasons"), added("risks", "warnings").alias("context_risks")
    return rows.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "strategy", reasons, risks, "invalidation")


@query("SELECT source, CASE WHEN regexp_full_match(upper(trim(source)), '[A-Z][A-Z0-9.]{0,5}') THEN upper(trim(source)) END AS tickers, count(*) AS rows FROM documents GROUP BY source")
def ticker_parsing(spark, sf):
    """Sources of documents read as tickers: trimmed, upper-cased, checked; what each was read as."""
    from barweave.operators.quality import parse_tickers

    rows = parse_tickers(B.table(spark, sf, "documents").select("source"), "source")
    return rows.groupBy("source", F.array_join("tickers", ",").alias("tickers")).agg(F.count("*").alias("rows"))
