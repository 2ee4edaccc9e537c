"""Queries a user asks: scan, analysis of tickers, movers, sectors, locked days, alerts on changes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions.scalars import r6
from barweave.operators import reports as H
from barweave.operators import signals as N
from barweave.sources import bars as B
from barweave.sources import instruments as J
from barweave.sources import store as T
from barweave.streaming import alerts as A
from barweave.streaming import quotes as Z

from . import oracle as O
from .catalogue_bars import KEY, cols, out
from .catalogue_research import _PX, _rounded
from .catalogue_signals import _CLASS, OUTCOMES, SCORED, outcomes
from .registry import query

_LAST = "WHERE ts = (SELECT max(ts) FROM sc)"


@query(f"{SCORED} SELECT {KEY}, strategy, {cols('score')}, {_CLASS}, row_number() OVER (ORDER BY score DESC, ticker, strategy) AS rank FROM sc {_LAST}")
def scan(spark, sf):
    """The signals of the last day that has any, ranked."""
    rows = H.scan(N.scored_signals(N.walk_context(spark, sf)))
    return out(rows, "strategy", "score", "class", "rank")


@query(f"{SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker, strategy) AS rank FROM sc) SELECT {KEY}, strategy, rank, {cols('entry', 'stop', 'target')} FROM rk WHERE rank <= 3")
def top_ranked_detail(spark, sf):
    """The three best signals of each day with their prices, joined by key."""
    scored = N.scored_signals(N.walk_context(spark, sf))
    ranks = N.ranked(scored).where("rank <= 3").select("ticker", "ts", "strategy", "rank")
    return out(H.with_detail(ranks, scored.select("ticker", "ts", "strategy", "entry", "stop", "target")), "strategy", "rank", "entry", "stop", "target")


_NUMBERS = tuple(c for c in (*H.LEVELS, *H.SHOWN) if c not in ("trend", "regime"))


@query(
    f"""{SCORED}, lv AS (SELECT *, min(low) OVER p AS support60, max(high) OVER p AS resistance60 FROM ctx WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
la AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1),
bs AS (SELECT ticker, ts, strategy, score, count(*) OVER (PARTITION BY ticker, ts) AS setups, {_CLASS} FROM sc QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY round(score, 6) DESC, strategy DESC) = 1)
SELECT la.ticker, strftime(la.ts, '%Y-%m-%d') AS ts, trend, regime, {cols('close', *_NUMBERS)}, coalesce(setups, 0) AS setups, bs.strategy, {O.r6('bs.score', 'score')}, bs.class FROM la LEFT JOIN bs ON bs.ticker = la.ticker AND bs.ts = la.ts"""
)
def analyses(spark, sf):
    """Everything about each ticker at its last bar."""
    features = N.walk_context(spark, sf)
    return out(H.analyses(features, N.scored_signals(features)), "trend", "regime", "close", *_NUMBERS, "setups", "strategy", "score", "class")


@query(f"WITH {O.walk()}, m AS (SELECT *, (close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1) * 100 AS change_pct FROM bars) SELECT {KEY}, {cols('change_pct')}, row_number() OVER (PARTITION BY ts ORDER BY round(change_pct, 6) DESC NULLS LAST, ticker) AS place FROM m")
def movers(spark, sf):
    """Tickers of each day by their change, those without one at the end."""
    return out(H.movers(B.walk(spark, sf)), "change_pct", "place")


@query(
    f"""WITH {O.walk('by_supplier')}, sd AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT *, (close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1) * 100 AS change_pct FROM bars)
SELECT sector, strftime(ts, '%Y-%m-%d') AS ts, count(*) AS tickers, round(sum(CAST(round(change_pct * 1e6) AS BIGINT)) / count(change_pct) / 1e6 + 1.3e-9, 6) + 0.0 AS change_pct, count(*) FILTER (WHERE change_pct > 0) AS rising FROM c JOIN sd ON sd.ticker = c.ticker GROUP BY ALL"""
)
def sector_moves(spark, sf):
    """Mean change of each sector's tickers by day; sectors come from the dimension of suppliers. Their number grows with the
    input, so only closes are made, and not stored: their change needs no other order of the rows."""
    closes = B.walk_closes(B.prints(spark, sf, "by_supplier"))
    rows = H.with_sector(H.movers(closes), B.sector_dimension(spark, sf)).groupBy("sector", "ts")
    mean = F.sum(F.round(F.col("change_pct") * 1e6).cast("long")) / F.count("change_pct") / 1e6
    rows = rows.agg(F.count("*").alias("tickers"), mean.alias("change_pct"), F.count(F.when(F.col("change_pct") > 0, 1)).alias("rising"))
    return _rounded(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")))


@query(f"WITH {O.walk('all')}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM bars) SELECT strftime(ts, '%Y-%m-%d') AS day, i FROM d WHERE ts = DATE '1995-06-15'")
def locked_day(spark, sf):
    """The place of a day in the benchmark's calendar; an error where it has no bar."""
    return H.locked_day(B.walk(spark, sf, "all"), F.to_date(F.lit("1995-06-15"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "i")


#: Kinds of alerts with their thresholds.
_KINDS = (("price_above", 200.0), ("price_below", 1.0), ("change_pct_above", 90.0), ("change_pct_below", -99.0), ("unknown", 1.0))
_VALUES = ", ".join(f"('{c}', {t}e0)" for c, t in _KINDS)


@query(
    f"""WITH t AS (SELECT event_id, ts, event_type AS symbol, {_PX} AS price FROM events), cl AS (SELECT symbol, arg_max(price, row(ts, event_id)) AS close FROM t WHERE ts < TIMESTAMP '2024-01-10' GROUP BY symbol),
x AS (SELECT t.*, (price / close - 1) * 100 AS change_pct FROM t LEFT JOIN cl ON cl.symbol = t.symbol WHERE ts >= TIMESTAMP '2024-01-10'), a(kind, threshold) AS (VALUES {_VALUES})
SELECT symbol || '_' || kind AS alert_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, round(arg_min(price, row(ts, event_id)) + 1.3e-9, 6) AS price FROM x JOIN a ON (kind = 'price_above' AND price >= threshold) OR (kind = 'price_below' AND price <= threshold)
 OR (kind = 'change_pct_above' AND round(change_pct, 9) >= threshold) OR (kind = 'change_pct_below' AND round(change_pct, 9) <= threshold) GROUP BY ALL"""
)
def change_alerts(spark, sf):
    """Alerts of all kinds on every symbol; those on the change compare with the last price before a day."""
    rows = B.ticks(spark, sf)
    cut = F.to_timestamp(F.lit("2024-01-10"))
    closes = Z.latest_quote(rows.where(F.col("ts") < cut)).select("symbol", F.col("price").alias("close"))
    now = A.with_change(rows.where(F.col("ts") >= cut), closes).withColumn("change_pct", F.round("change_pct", 9))
    kinds = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(t).alias("threshold")) for c, t in _KINDS])
    alerts = rows.select("symbol").distinct().select("symbol", F.explode(kinds).alias("x")).select(F.concat_ws("_", "symbol", "x.condition").alias("alert_id"), "symbol", "x.*")
    return A.alert_hits(now, alerts).select("alert_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r6("price").alias("price"))


@query(
    f"""SELECT event_type AS ticker, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d') AS ts, round(arg_min({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS open, round(max({_PX}) + 1.3e-9, 6) AS high, round(min({_PX}) + 1.3e-9, 6) AS low,
 round(arg_max({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""
)
def weekly_tick_bars(spark, sf):
    """Bars of ticks over weeks from Monday; the same plan runs as a stream."""
    return out(Z.live_bars(B.ticks(spark, sf), "1 week"), "open", "high", "low", "close", "volume")


_NYD = "CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)"


@query(
    f"""SELECT event_type AS ticker, strftime({_NYD}, '%Y-%m-%d') AS ts, round(arg_min({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS open, round(max({_PX}) + 1.3e-9, 6) AS high, round(min({_PX}) + 1.3e-9, 6) AS low,
 round(arg_max({_PX}, row(ts, event_id)) + 1.3e-9, 6) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""
)
def daily_tick_bars(spark, sf):
    """Bars of ticks over New York days."""
    return out(Z.live_bars(B.ticks(spark, sf), "1 day", zone="America/New_York"), "open", "high", "low", "close", "volume")


_CHART = tuple(c for names in H.CHART.values() for c in names)


@query(f"WITH RECURSIVE {O.features()} SELECT {KEY}, {cols('close', *_CHART)} FROM feat")
def chart_bundle(spark, sf):
    from barweave.functions import indicators as I

    return out(H.chart_bundle(I.features_daily(B.walk(spark, sf))), "close", *_CHART)


@query(f"WITH {O.walk('by_supplier')} SELECT {KEY}, {cols('open', 'high', 'low', 'close', 'volume')} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 500")
def recent_bars(spark, sf):
    return out(H.recent_bars(B.walk(spark, sf, "by_supplier")), "open", "high", "low", "close", "volume")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, r_name AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND (starts_with(CAST(s_suppkey AS VARCHAR), '1') OR contains(upper(s_name), '1')) ORDER BY starts_with(CAST(s_suppkey AS VARCHAR), '1') DESC, symbol LIMIT 10")
def search_symbols(spark, sf):
    """Suppliers as instruments, searched by a text; ten at most."""
    names = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"))
    rows = names.join(B.sector_dimension(spark, sf), "ticker").select(F.col("ticker").alias("symbol"), "name", F.col("sector").alias("kind"))
    return H.search_symbols(rows, F.lit(" 1 "), ("ASIA", "EUROPE"))


@query(
    f"""{OUTCOMES}, hr AS (SELECT strategy, regime, count(*) AS regime_trades, avg((net > 0)::INT) AS regime_win_rate FROM oc GROUP BY ALL), ht AS (SELECT strategy, ticker, count(*) AS ticker_trades, avg((net > 0)::INT) AS ticker_win_rate FROM oc GROUP BY ALL),
hs AS (SELECT strategy, count(*) >= 20 AS sufficient FROM oc GROUP BY strategy)
SELECT {KEY.replace('ticker,', 'sc.ticker,')}, sc.strategy, regime_trades, {cols('regime_win_rate')}, ticker_trades, {cols('ticker_win_rate')}, coalesce(sufficient, false) AS sufficient FROM sc LEFT JOIN hr ON hr.strategy = sc.strategy AND hr.regime = sc.regime
 LEFT JOIN ht ON ht.strategy = sc.strategy AND ht.ticker = sc.ticker LEFT JOIN hs ON hs.strategy = sc.strategy"""
)
def signal_history(spark, sf):
    """Signals with the record of their strategy in the same regime and on the same ticker."""
    found = N.scored_signals(N.walk_context(spark, sf))
    trades = outcomes(spark, sf)
    rows = H.with_history(found, trades)
    return out(rows, "strategy", "regime_trades", "regime_win_rate", "ticker_trades", "ticker_win_rate", "sufficient")


def _as_of(name: str, same: str) -> str:
    """Counts of closed trades before the signal, by all pairs."""
    return f"""{name} AS (SELECT sc.ticker, sc.ts, sc.strategy, count(oc.net) AS {name}_trades, avg((oc.net > 0)::INT) AS {name}_win_rate FROM sc LEFT JOIN oc ON oc.strategy = sc.strategy AND oc.exit_ts < sc.ts{same} GROUP BY ALL)"""


@query(
    f"""{OUTCOMES}, {_as_of("by_regime", " AND oc.regime = sc.regime")}, {_as_of("by_ticker", " AND oc.ticker = sc.ticker")}, {_as_of("by_strategy", "")}
SELECT {KEY.replace('ticker,', 'sc.ticker,').replace('ts,', 'sc.ts,', 1).replace('strftime(ts', 'strftime(sc.ts')}, sc.strategy, CASE WHEN regime IS NOT NULL THEN by_regime_trades END AS regime_trades, {O.r6('by_regime_win_rate', 'regime_win_rate')}, by_ticker_trades AS ticker_trades,
 {O.r6('by_ticker_win_rate', 'ticker_win_rate')}, by_strategy_trades AS strategy_trades, by_strategy_trades >= 20 AS sufficient FROM sc JOIN by_regime r ON r.ticker = sc.ticker AND r.ts = sc.ts AND r.strategy = sc.strategy
 JOIN by_ticker t ON t.ticker = sc.ticker AND t.ts = sc.ts AND t.strategy = sc.strategy JOIN by_strategy s ON s.ticker = sc.ticker AND s.ts = sc.ts AND s.strategy = sc.strategy"""
)
def signal_history_as_of(spark, sf):
    """Signals with the record of their strategy as it was known on their day."""
    found = N.scored_signals(N.walk_context(spark, sf))
    rows = H.with_history_as_of(found, outcomes(spark, sf))
    return out(rows, "strategy", "regime_trades", "regime_win_rate", "ticker_trades", "ticker_win_rate", "strategy_trades", "sufficient")


@query(
    """WITH w AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS monday FROM lineitem),
g AS (SELECT ticker, monday + 7 AS a, CAST(lead(monday) OVER (PARTITION BY ticker ORDER BY monday) AS DATE) - 1 AS b FROM w)
SELECT ticker, strftime(a, '%Y-%m-%d') AS start, strftime(b, '%Y-%m-%d') AS "end" FROM g WHERE b >= a"""
)
def missing_ranges(spark, sf):
    """What a store that has the weeks with trades of each supplier lacks of its whole history."""
    days = B.prints(spark, sf, "by_supplier").select("ticker", "ts")
    wanted = days.groupBy("ticker").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    weeks = days.select("ticker", F.date_trunc("week", "ts").cast("date").alias("start")).distinct().withColumn("end", F.date_add("start", 6))
    rows = T.subtract_ranges(wanted, weeks)
    return rows.select("ticker", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start", "end")])


@query(
    """WITH n AS (SELECT event_type AS symbol, event_id, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-20')
SELECT symbol, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n.ts DESC, event_id DESC) <= 30"""
)
def recent_news(spark, sf):
    """Events as items of news: of each symbol the newest thirty of a week."""
    items = B.ticks(spark, sf).select("symbol", F.col("event_id").alias("id"), "ts")
    rows = H.recent_news(items, F.to_timestamp(F.lit("2024-01-20 12:00:00")))
    return rows.select("symbol", F.col("id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    f"""WITH {O.walk('by_supplier')}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 30), q AS (SELECT ticker, arg_max(close, ts) AS price, CAST(floor(avg(volume)) AS BIGINT) AS avg_volume FROM l GROUP BY ticker)
SELECT q.ticker, s_name AS name, {O.r6('price')}, avg_volume, r_name AS sector FROM q JOIN supplier ON CAST(s_suppkey AS VARCHAR) = q.ticker LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def instruments(spark, sf):
    """Suppliers as instruments: name, last price, mean volume, sector."""
    names = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"))
    profiles = B.sector_dimension(spark, sf).select(F.col("ticker").alias("symbol"), "sector", F.lit(None).cast("string").alias("industry"))
    rows = J.instruments(J.quotes_of_bars(B.walk(spark, sf, "by_supplier"), names), profiles)
    return rows.select("ticker", "name", r6("price").alias("price"), "avg_volume", "sector")
