"""Queries on bars, their quality, calendars and indicators; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions import indicators as I
from barweave.functions.scalars import r6
from barweave.operators import calendar as C
from barweave.operators import quality as Q
from barweave.sources import bars as B

from . import oracle as O
from .registry import query

KEY = "ticker, strftime(ts, '%Y-%m-%d') AS ts"


def out(df: DataFrame, *columns: str, extra: tuple = ()) -> DataFrame:
    """ticker, ts as text, doubles rounded."""
    kinds = dict(df.dtypes)
    picked = []
    for c in columns:
        picked.append((r6(c) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c))
    return df.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("ts"), *picked, *extra)


def cols(*names: str) -> str:
    return ", ".join(O.r6(n) for n in names)


BAR = ("open", "high", "low", "close", "volume")


@query(f"WITH {O.raw()} SELECT {KEY}, {cols(*BAR)} FROM bars")
def daily_bars(spark, sf):
    return out(B.raw_bars(B.prints(spark, sf)), *BAR)


@query(f"WITH {O.walk()} SELECT {KEY}, {cols(*BAR)} FROM bars")
def walk_bars(spark, sf):
    return out(B.walk(spark, sf), *BAR)


@query(
    f"WITH {O.walk()} SELECT ticker, strftime(date_trunc('week', ts), '%Y-%m-%d') AS ts, round(arg_min(open, ts) + 1.3e-9, 6) AS open, round(max(high) + 1.3e-9, 6) AS high, round(min(low) + 1.3e-9, 6) AS low, round(arg_max(close, ts) + 1.3e-9, 6) AS close, sum(volume) AS volume, count(*) AS days FROM bars GROUP BY ticker, date_trunc('week', ts)"
)
def weekly_bars(spark, sf):
    return out(B.weekly_bars(B.walk(spark, sf)), *BAR, "days")


@query(f"WITH {O.intraday()} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts, {cols(*BAR)} FROM bars")
def hourly_event_bars(spark, sf):
    return _hours(B.intraday_bars(B.ticks(spark, sf)), BAR)


def _hours(df: DataFrame, columns) -> DataFrame:
    return df.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), *[(r6(c) + F.lit(0.0)).alias(c) for c in columns])


@query(
    f"""WITH {O.raw()}, x AS (SELECT *, lag(close) OVER w AS prev_close, lag(ts) OVER w AS prev_ts, count(*) OVER (PARTITION BY ticker) AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
i AS (SELECT ticker, unnest([CASE WHEN high < low THEN 'INVALID_HIGH_LOW' END, CASE WHEN open < 0 OR high < 0 OR low < 0 OR close < 0 THEN 'NEGATIVE_PRICE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END,
 CASE WHEN high < greatest(open, close) THEN 'HIGH_LOW_INCONSISTENT' END, CASE WHEN low > least(open, close) THEN 'LOW_HIGH_INCONSISTENT' END, CASE WHEN volume = 0 THEN 'ZERO_VOLUME' END,
 CASE WHEN prev_close > 0 AND abs(open - prev_close) / prev_close > 0.10 THEN 'LARGE_GAP' END,
 CASE WHEN date_diff('day', prev_ts, ts) > 3 AND len(list_filter(generate_series(CAST(prev_ts AS TIMESTAMP) + INTERVAL 1 DAY, CAST(ts AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) > 0 THEN 'DATE_GAPS' END]) AS code FROM x)
SELECT ticker, code, count(*) AS issues FROM i WHERE code IS NOT NULL GROUP BY ALL
UNION ALL SELECT ticker, 'INSUFFICIENT_HISTORY', 1 FROM bars GROUP BY ticker HAVING count(*) < 252"""
)
def bar_issues(spark, sf):
    return Q.bar_issues(B.raw_bars(B.prints(spark, sf))).groupBy("ticker", "code").agg(F.count("*").alias("issues"))


@query(
    f"""WITH {O.raw('by_brand')}, x AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS p FROM bars)
SELECT ticker, count(*) AS bars, sum(CAST(volume = 0 AS INT))::BIGINT AS zero_volume, sum(CAST(coalesce(abs(open - p) / nullif(p, 0) > 0.10, false) AS INT))::BIGINT AS large_gaps,
round(greatest(0, least(1, 1.0 - 0.3 * CAST(count(*) < 60 AS INT) - 0.2 * CAST(count(*) < 252 AS INT) - 0.1 * CAST(sum(CAST(volume = 0 AS INT)) > 0.05 * count(*) AS INT) - 0.1 * CAST(sum(CAST(coalesce(abs(open - p) / nullif(p, 0) > 0.10, false) AS INT)) > 0.02 * count(*) AS INT))) + 1.3e-9, 6) + 0.0 AS score
FROM x GROUP BY ticker"""
)
def quality_score(spark, sf):
    return Q.quality_score(B.raw_bars(B.prints(spark, sf, "by_brand"))).select("ticker", "bars", "zero_volume", "large_gaps", r6("score").alias("score"))


@query(
    f"""WITH {O.walk('by_supplier')}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM bars),
s AS (SELECT ticker, count(*) AS n, arg_max(close, ts) AS price, avg(CASE WHEN back <= 30 THEN volume END) AS avg_volume FROM x GROUP BY ticker)
SELECT ticker, n AS bars, round(price + 1.3e-9, 6) AS price, round(avg_volume + 1.3e-9, 6) AS avg_volume,
concat_ws('; ', CASE WHEN n < 252 THEN 'Insufficient history' END, CASE WHEN price < 5 THEN 'Price below minimum' END, CASE WHEN avg_volume < 25 THEN 'Average volume below minimum' END, CASE WHEN price * avg_volume < 2000 THEN 'Dollar volume below minimum' END) AS reasons,
n >= 252 AND price >= 5 AND avg_volume >= 25 AND price * avg_volume >= 2000 AS member FROM s"""
)
def universe_membership(spark, sf):
    return Q.universe_membership(B.walk(spark, sf, "by_supplier"), min_price=5, min_volume=25, min_dollars=2000).select("ticker", "bars", r6("price").alias("price"), r6("avg_volume").alias("avg_volume"), "reasons", "member")


@query(
    f"""WITH {O.raw('by_brand')}, x AS (SELECT *, lag(close) OVER w AS p, lag(ts) OVER w AS pt FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
s AS (SELECT ticker, count(*) AS n, count(*) FILTER (WHERE p > 0 AND abs(open - p) / p > 0.10) AS gaps, count(*) FILTER (WHERE date_diff('day', pt, ts) > 3) AS holes FROM x GROUP BY ticker)
SELECT ticker, n >= 252 AND 1.0 - 0.1 * CAST(gaps > 0.02 * n AS INT) >= 0.5 AS passed, gaps AS large_gaps, holes AS date_gaps, CASE WHEN n < 252 THEN 'INSUFFICIENT_HISTORY' ELSE '' END AS errors FROM s"""
)
def universe_audit(spark, sf):
    return Q.audit_universe(B.raw_bars(B.prints(spark, sf, "by_brand")))


@query(
    f"""WITH {O.walk()}, k AS (SELECT count(DISTINCT ticker) AS k FROM bars), c AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT ticker) = (SELECT k FROM k))
SELECT ticker, count(*) FILTER (WHERE ts IN (SELECT ts FROM c)) AS kept, count(*) FILTER (WHERE ts NOT IN (SELECT ts FROM c)) AS dropped FROM bars GROUP BY ticker"""
)
def aligned_calendar(spark, sf):
    return C.alignment_report(B.walk(spark, sf))


_HOLIDAYS = """y AS (SELECT CAST(range AS INT) AS y FROM range(1990, 2031)),
e0 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e0),
e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e1),
e3 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS q FROM e2),
easter AS (SELECT y, make_date(y, CAST(q // 31 AS INT), CAST(q % 31 + 1 AS INT)) AS d FROM e3),
fixed AS (SELECT y, make_date(y, m, d) AS d, name FROM y, (VALUES (1, 1, 'New Year'), (6, 19, 'Juneteenth'), (7, 4, 'Independence Day'), (12, 25, 'Christmas')) t(m, d, name) WHERE name <> 'Juneteenth' OR y >= 2022),
nth AS (SELECT y, make_date(y, m, 1) + CAST((dow - dayofweek(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INT) AS d, name FROM y, (VALUES (1, 1, 3, 'Martin Luther King Day'), (2, 1, 3, 'Presidents Day'), (9, 1, 1, 'Labor Day'), (11, 4, 4, 'Thanksgiving')) t(m, dow, n, name)),
hol AS (SELECT y, d + CAST(CASE dayofweek(d) WHEN 6 THEN -1 WHEN 0 THEN 1 ELSE 0 END AS INT) AS d, name FROM fixed UNION ALL SELECT * FROM nth
 UNION ALL SELECT y, make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) + 6) % 7 AS INT), 'Memorial Day' FROM y UNION ALL SELECT y, d - 2, 'Good Friday' FROM easter)"""


@query(f"WITH {_HOLIDAYS}, o AS (SELECT year(l_shipdate)::BIGINT AS year, count(*) AS prints FROM lineitem GROUP BY 1) SELECT o.year, prints, name AS holiday, strftime(d, '%Y-%m-%d') AS date FROM o JOIN hol ON hol.y = o.year")
def us_holidays(spark, sf):
    years = B.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.count("*").alias("prints"))
    return years.join(C.us_holidays(spark, 1990, 2030), "year").select("year", "prints", "holiday", F.date_format("dt", "yyyy-MM-dd").alias("date"))


@query(
    f"""WITH {O.walk('by_brand')}, {_HOLIDAYS}, span AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT ticker, min(ts) AS a, max(ts) AS b FROM bars GROUP BY ticker)),
days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM span),
trading AS (SELECT ts FROM days WHERE isodow(ts) < 6 AND NOT EXISTS (SELECT 1 FROM hol WHERE hol.d = ts AND hol.y = year(ts)))
SELECT ticker, count(*) AS missing, strftime(min(ts), '%Y-%m-%d') AS first_missing FROM (SELECT DISTINCT ticker FROM bars) t, trading WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.ts = trading.ts) GROUP BY ticker"""
)
def calendar_gaps(spark, sf):
    gaps = C.calendar_gaps(B.walk(spark, sf, "by_brand"))
    return gaps.groupBy("ticker").agg(F.count("*").alias("missing"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_missing"))


def _windows(*names: str, universe: str = "by_type"):
    def run(spark, sf):
        return out(I.add_windows(B.walk(spark, sf, universe)), *names)

    return f"WITH {O.walk(universe)}, {O.windows()} SELECT {KEY}, {', '.join(n if n == 'volume_spike' else O.r6(n) for n in names)} FROM feat", run


def _recursive(*names: str):
    def run(spark, sf):
        return out(I.add_recursive(B.walk(spark, sf), point_in_time=True), *names)

    return f"WITH RECURSIVE {O.walk()}, {O.recursive()} SELECT {KEY}, {cols(*names)} FROM rec", run


for _name, _columns in {
    "sma_set": ("sma20", "sma50", "sma200"),
    "stochastic": ("stoch_k", "stoch_d"),
    "roc12": ("roc12",),
    "bollinger": ("bb_upper", "bb_lower", "bb_width"),
    "hist_vol": ("hist_vol20",),
    "rel_volume": ("vol_sma20", "rel_volume", "volume_spike"),
    "obv": ("obv",),
    "dollar_volume": ("dollar_volume30",),
}.items():
    _sql, _run = _windows(*_columns)
    query(_sql, name=_name)(_run)
for _name, _columns in {"ema_set": ("ema9", "ema21", "ema50"), "rsi14": ("rsi14", "rsi9"), "macd": ("macd", "macd_signal", "macd_hist"), "adx14": ("plus_di", "minus_di", "adx14"), "atr14": ("atr14",)}.items():
    _sql, _run = _recursive(*_columns)
    query(_sql, name=_name)(_run)

_SNAPSHOT = ("sma20", "sma50", "sma200", "ema21", "rsi14", "macd_hist", "stoch_k", "roc12", "adx14", "atr14", "bb_width", "hist_vol20", "rel_volume", "obv", "dollar_volume30")


@query(f"WITH RECURSIVE {O.features()} SELECT {KEY}, {cols(*_SNAPSHOT)} FROM feat")
def features_daily(spark, sf):
    return out(I.features_daily(B.walk(spark, sf)), *_SNAPSHOT)


@query(f"WITH RECURSIVE {O.features()} SELECT {KEY}, {cols('close', *_SNAPSHOT)} FROM feat QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1")
def latest_snapshot(spark, sf):
    rows = I.features_daily(B.walk(spark, sf))
    best = rows.groupBy("ticker").agg(F.max_by(F.struct("ts", "close", *_SNAPSHOT), "ts").alias("x")).select("ticker", "x.*")
    return out(best, "close", *_SNAPSHOT)


_NY = "CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)"
_VWAP = f"v AS (SELECT *, {_NY} AS ny_day, sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0) AS vwap FROM bars WINDOW d AS (PARTITION BY ticker, {_NY} ORDER BY ts ROWS UNBOUNDED PRECEDING))"
_RANGE = """g AS (SELECT *, row_number() OVER d AS day_bar, first(open) OVER d AS session_open FROM v WINDOW d AS (PARTITION BY ticker, ny_day ORDER BY ts ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, CASE WHEN day_bar >= 3 THEN max(CASE WHEN day_bar <= 3 THEN high END) OVER d END AS or_high, CASE WHEN day_bar >= 3 THEN min(CASE WHEN day_bar <= 3 THEN low END) OVER d END AS or_low, (close - session_open) / nullif(session_open, 0) AS session_change FROM g WINDOW d AS (PARTITION BY ticker, ny_day ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
HOUR = "ticker, strftime(ts, '%Y-%m-%d %H:%M') AS ts"


@query(f"WITH {O.intraday()}, {_VWAP} SELECT {HOUR}, {cols('vwap')} FROM v")
def session_vwap(spark, sf):
    return _hours(I.session_vwap(B.intraday_bars(B.ticks(spark, sf))), ("vwap",))


@query(f"WITH {O.intraday()}, {_VWAP}, {_RANGE} SELECT {HOUR}, {cols('or_high', 'or_low', 'session_change')} FROM o")
def opening_range(spark, sf):
    return _hours(I.opening_range(I.session_vwap(B.intraday_bars(B.ticks(spark, sf)))), ("or_high", "or_low", "session_change"))


@query(
    f"WITH {O.walk()}, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM bars), x AS (SELECT * FROM t WHERE back <= 126) SELECT {KEY}, round((close / first_value(close) OVER (PARTITION BY ticker ORDER BY ts) - 1) * 100 + 1.3e-9, 6) + 0.0 AS rebased FROM x"
)
def rebased_compare(spark, sf):
    from pyspark.sql import Window

    back = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    rows = B.walk(spark, sf).withColumn("back", F.row_number().over(back)).where("back <= 126")
    base = F.first("close").over(I.by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return out(rows.withColumn("rebased", (F.col("close") / base - 1) * 100), "rebased")
