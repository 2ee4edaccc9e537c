"""Pieces of SQL that the oracles share."""

from __future__ import annotations

_TICKER = {"by_type": ("p_type", " JOIN part ON l_partkey = p_partkey"), "by_brand": ("p_brand", " JOIN part ON l_partkey = p_partkey"), "by_supplier": ("CAST(l_suppkey AS VARCHAR)", ""), "all": ("'ALL'", ""), "by_region": ("r_name", " JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")}


def r6(x: str, name: str | None = None) -> str:
    return f"round({x} + 1.3e-9, 6) + 0.0 AS {name or x}"  # off the ties, where engines round apart


def raw(universe: str = "by_type", name: str = "bars") -> str:
    ticker, join = _TICKER[universe]
    seq = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    px = "l_extendedprice / nullif(l_quantity, 0)"
    return f"""{name} AS (SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS ts, arg_min({px}, {seq}) AS open, max({px}) AS high,
 min({px}) AS low, arg_max({px}, {seq}) AS close, sum(l_quantity) AS volume FROM lineitem{join} GROUP BY 1, 2)"""


def walk(universe: str = "by_type", name: str = "bars") -> str:
    ticker, join = _TICKER[universe]
    return f"""{name}_d AS (SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS ts, sum(CAST(round(l_discount * 100) AS BIGINT)) AS cents, count(*) AS n,
 max(l_discount) - min(l_discount) AS spread, sum(l_quantity) AS volume FROM lineitem{join} GROUP BY 1, 2),
{name}_c AS (SELECT *, round(exp(sum(CAST(round((cents / (n * 100.0) - 0.05) * 1000000) AS BIGINT)) OVER (PARTITION BY ticker ORDER BY ts) / 1000000.0) * 100, 4) AS close FROM {name}_d),
{name}_o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY ts), 100.0) AS open FROM {name}_c),
{name} AS (SELECT ticker, ts, open, round(greatest(open, close) * (1 + spread * 0.1) + 3e-8, 4) AS high, round(least(open, close) * (1 - spread * 0.1) + 3e-8, 4) AS low, close, volume FROM {name}_o)"""


def intraday(name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS ticker, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, arg_min(greatest(value, 0.01), row(ts, event_id)) AS open, max(greatest(value, 0.01)) AS high,
 min(greatest(value, 0.01)) AS low, arg_max(greatest(value, 0.01), row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


def recursive(source: str = "bars", name: str = "rec") -> str:
    """All recursive indicators by a recursive query over row numbers; needs WITH RECURSIVE."""
    emas = {9: "e9", 12: "e12", 21: "e21", 26: "e26", 50: "e50"}
    first = ", ".join(f"close AS {e}" for e in emas.values())
    def step(n, e):
        k = f"{2 / (n + 1)!r}e0"
        d = f"{1 - 2 / (n + 1)!r}e0"
        return f"CASE WHEN b.rn < {n} THEN p.{e} + b.close WHEN b.rn = {n} THEN (p.{e} + b.close) / {n} ELSE b.close * {k} + p.{e} * {d} END AS {e}"
    def mean(x, v, n, first):
        last = first + n - 1
        return f"CASE WHEN b.rn < {first} THEN 0e0 WHEN b.rn < {last} THEN p.{x} + b.{v} WHEN b.rn = {last} THEN (p.{x} + b.{v}) / {n} ELSE (p.{x} * {n - 1} + b.{v}) / {n} END AS {x}"
    def total(x, v):
        return f"CASE WHEN b.rn <= 15 THEN p.{x} + b.{v} ELSE p.{x} - p.{x} / 14 + b.{v} END AS {x}"
    steps = ", ".join(step(n, e) for n, e in emas.items())
    return f"""{name}_x AS (SELECT *, row_number() OVER w AS rn, coalesce(greatest(close - lag(close) OVER w, 0e0), 0e0) AS gain, coalesce(greatest(lag(close) OVER w - close, 0e0), 0e0) AS loss,
 CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
 CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high - lag(high) OVER w > 0 THEN high - lag(high) OVER w ELSE 0e0 END AS pdm,
 CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w - low > 0 THEN lag(low) OVER w - low ELSE 0e0 END AS mdm
 FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
{name}_1 AS (
 SELECT ticker, rn, {first}, 0e0 AS ag9, 0e0 AS al9, 0e0 AS ag, 0e0 AS al, tr AS atr, 0e0 AS s_tr, 0e0 AS s_p, 0e0 AS s_m FROM {name}_x WHERE rn = 1
 UNION ALL
 SELECT b.ticker, b.rn, {steps}, {mean('ag9', 'gain', 9, 2)}, {mean('al9', 'loss', 9, 2)}, {mean('ag', 'gain', 14, 2)}, {mean('al', 'loss', 14, 2)}, {mean('atr', 'tr', 14, 1)}, {total('s_tr', 'tr')}, {total('s_p', 'pdm')}, {total('s_m', 'mdm')}
 FROM {name}_1 p JOIN {name}_x b ON b.ticker = p.ticker AND b.rn = p.rn + 1),
{name}_2 AS (SELECT *, CASE WHEN rn >= 26 THEN e12 - e26 END AS macd, CASE WHEN rn >= 15 THEN CASE WHEN s_tr = 0 THEN 0 ELSE s_p / s_tr * 100 END END AS pdi, CASE WHEN rn >= 15 THEN CASE WHEN s_tr = 0 THEN 0 ELSE s_m / s_tr * 100 END END AS mdi FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0 ELSE abs(pdi - mdi) / (pdi + mdi) * 100 END AS dx FROM {name}_2),
{name}_4 AS (
 SELECT ticker, rn, 0e0 AS sig, 0e0 AS adx FROM {name}_3 WHERE rn = 1
 UNION ALL
 SELECT b.ticker, b.rn, CASE WHEN b.rn < 26 THEN 0e0 WHEN b.rn < 34 THEN p.sig + b.macd WHEN b.rn = 34 THEN (p.sig + b.macd) / 9 ELSE b.macd * 0.2e0 + p.sig * 0.8e0 END AS sig,
 CASE WHEN b.rn < 15 THEN 0e0 WHEN b.rn < 28 THEN p.adx + b.dx WHEN b.rn = 28 THEN (p.adx + b.dx) / 14 ELSE (p.adx * 13 + b.dx) / 14 END AS adx
 FROM {name}_4 p JOIN {name}_3 b ON b.ticker = p.ticker AND b.rn = p.rn + 1),
{name} AS (SELECT x.ticker, x.ts, x.open, x.high, x.low, x.close, x.volume, x.rn, {', '.join(f'CASE WHEN x.rn >= {n} THEN {e} END AS ema{n}' for n, e in emas.items())},
 CASE WHEN x.rn >= 10 THEN CASE WHEN al9 = 0 THEN CASE WHEN ag9 = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + ag9 / al9) END END AS rsi9,
 CASE WHEN x.rn >= 15 THEN CASE WHEN al = 0 THEN CASE WHEN ag = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + ag / al) END END AS rsi14,
 macd, CASE WHEN x.rn >= 34 THEN sig END AS macd_signal, CASE WHEN x.rn >= 34 THEN macd - sig END AS macd_hist,
 CASE WHEN x.rn >= 14 THEN atr END AS atr14_full, CASE WHEN x.rn >= 15 THEN atr END AS atr14, CASE WHEN x.rn >= 29 THEN pdi END AS plus_di, CASE WHEN x.rn >= 29 THEN mdi END AS minus_di, CASE WHEN x.rn >= 29 THEN adx END AS adx14
 FROM {name}_x x JOIN {name}_3 y ON x.ticker = y.ticker AND x.rn = y.rn JOIN {name}_4 z ON x.ticker = z.ticker AND x.rn = z.rn)"""


def windows(source: str = "bars", name: str = "feat") -> str:
    """The indicators that plain windows give, on top of all columns of ``source``."""
    w = "PARTITION BY ticker ORDER BY ts"
    f = lambda a, b: f"({w} ROWS BETWEEN {a} AND {b})"
    p = lambda n: f(f"{n} PRECEDING", "CURRENT ROW")
    return f"""{name}_1 AS (SELECT * EXCLUDE (rn), row_number() OVER ({w}) AS rn, ln(close / nullif(lag(close) OVER ({w}), 0)) AS log_return, lag(close) OVER ({w}) AS prev_close,
 CASE WHEN row_number() OVER ({w}) >= 14 THEN CASE WHEN max(high) OVER {p(13)} = min(low) OVER {p(13)} THEN 50.0 ELSE (close - min(low) OVER {p(13)}) / (max(high) OVER {p(13)} - min(low) OVER {p(13)}) * 100 END END AS raw_k
 FROM (SELECT *{"" if source == "rec" else ", 0 AS rn"} FROM {source})),
{name}_2 AS (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER {p(19)} END AS sma20, CASE WHEN rn >= 50 THEN avg(close) OVER {p(49)} END AS sma50, CASE WHEN rn >= 200 THEN avg(close) OVER {p(199)} END AS sma200,
 CASE WHEN rn >= 20 THEN stddev_pop(close) OVER {p(19)} END AS bb_std, (close - lag(close, 12) OVER ({w})) / nullif(lag(close, 12) OVER ({w}), 0) * 100 AS roc12,
 CASE WHEN rn >= 20 THEN avg(volume) OVER {p(19)} END AS vol_sma20, CASE WHEN rn > 20 THEN volume / nullif(avg(volume) OVER {f('20 PRECEDING', '1 PRECEDING')}, 0) END AS rel_volume,
 CASE WHEN rn >= 21 THEN stddev_samp(log_return) OVER {p(19)} * sqrt(252.0) END AS hist_vol20,
 coalesce(sum(sign(close - prev_close) * volume) OVER {f('UNBOUNDED PRECEDING', 'CURRENT ROW')}, 0.0) AS obv, CASE WHEN rn >= 30 THEN avg(close * volume) OVER {p(29)} END AS dollar_volume30,
 CASE WHEN count(raw_k) OVER {p(2)} = 3 THEN avg(raw_k) OVER {p(2)} END AS stoch_k FROM {name}_1),
{name} AS (SELECT *, sma20 + 2 * bb_std AS bb_upper, sma20 - 2 * bb_std AS bb_lower, 4 * bb_std / nullif(sma20, 0) AS bb_width,
 CASE WHEN count(stoch_k) OVER {p(2)} = 3 THEN avg(stoch_k) OVER {p(2)} END AS stoch_d, coalesce(rel_volume >= 2.0, false) AS volume_spike FROM {name}_2)"""


def features(universe: str = "by_type") -> str:
    return f"{walk(universe)}, {recursive()}, {windows('rec')}"


def structure(source: str = "feat", name: str = "st") -> str:
    """Swings, structure, levels and the frames that patterns read."""
    w = "PARTITION BY ticker ORDER BY ts"
    f = lambda a, b: f"({w} ROWS BETWEEN {a} AND {b})"
    pre, post, so_far = f("3 PRECEDING", "1 PRECEDING"), f("1 FOLLOWING", "3 FOLLOWING"), f("UNBOUNDED PRECEDING", "CURRENT ROW")
    prior = f("20 PRECEDING", "1 PRECEDING")
    box = f("56 PRECEDING", "3 PRECEDING")
    imp, flag = f("14 PRECEDING", "5 PRECEDING"), f("4 PRECEDING", "CURRENT ROW")
    return f"""{name}_1 AS (SELECT *, CASE WHEN count(*) OVER {pre} = 3 AND count(*) OVER {post} = 3 AND high > max(high) OVER {pre} AND high > max(high) OVER {post} THEN high END AS sh,
 CASE WHEN count(*) OVER {pre} = 3 AND count(*) OVER {post} = 3 AND low < min(low) OVER {pre} AND low < min(low) OVER {post} THEN low END AS sl FROM {source}),
{name}_2 AS (SELECT *, CASE WHEN sh IS NOT NULL THEN struct_pack(p := sh, q := last_value(sh IGNORE NULLS) OVER {f('UNBOUNDED PRECEDING', '1 PRECEDING')}) END AS shs,
 CASE WHEN sl IS NOT NULL THEN struct_pack(p := sl, q := last_value(sl IGNORE NULLS) OVER {f('UNBOUNDED PRECEDING', '1 PRECEDING')}) END AS sls FROM {name}_1),
{name}_3 AS (SELECT *, lag(shs, 3) OVER ({w}) AS shl, lag(sls, 3) OVER ({w}) AS sll FROM {name}_2),
{name}_4 AS (SELECT *, last_value(shl IGNORE NULLS) OVER {so_far} AS lh, last_value(sll IGNORE NULLS) OVER {so_far} AS ll FROM {name}_3),
{name}_5 AS (SELECT *, lh.p AS last_sh, lh.q AS prev_sh, ll.p AS last_sl, ll.q AS prev_sl,
 CASE WHEN lh.q IS NULL OR ll.q IS NULL THEN 'insufficient_data' WHEN lh.p > lh.q AND ll.p > ll.q THEN 'uptrend' WHEN lh.p < lh.q AND ll.p < ll.q THEN 'downtrend' ELSE 'sideways' END AS trend,
 max(high) OVER {prior} AS resistance20, min(low) OVER {prior} AS support20,
 CASE WHEN rn >= 20 THEN max(high) OVER {f('19 PRECEDING', 'CURRENT ROW')} END AS hi20, CASE WHEN rn >= 20 THEN min(low) OVER {f('19 PRECEDING', 'CURRENT ROW')} END AS lo20,
 CASE WHEN rn >= 16 THEN max(high) OVER {f('15 PRECEDING', '1 PRECEDING')} END AS hi15p, CASE WHEN rn >= 16 THEN min(low) OVER {f('15 PRECEDING', '1 PRECEDING')} END AS lo15p,
 lag(sma20) OVER ({w}) AS prev_sma20, lag(sma50) OVER ({w}) AS prev_sma50, lag(sma200) OVER ({w}) AS prev_sma200,
 lag(low, 14) OVER ({w}) AS imp_low, lag(high, 14) OVER ({w}) AS imp_high, CASE WHEN rn >= 15 THEN max(high) OVER {imp} END AS imp_max, CASE WHEN rn >= 15 THEN min(low) OVER {imp} END AS imp_min,
 max(high) OVER {flag} AS flag_high, min(low) OVER {flag} AS flag_low, avg(volume) OVER {imp} AS imp_volume, avg(volume) OVER {flag} AS flag_volume,
 CASE WHEN bb_width IS NOT NULL AND count(bb_width) OVER {f('59 PRECEDING', 'CURRENT ROW')} >= 10 THEN min(bb_width) OVER {f('59 PRECEDING', 'CURRENT ROW')} END AS width_min, max(bb_width) OVER {f('59 PRECEDING', 'CURRENT ROW')} AS width_max,
 list(struct_pack(n := rn, p := sh)) FILTER (WHERE sh IS NOT NULL) OVER {box} AS highs, list(struct_pack(n := rn, p := sl)) FILTER (WHERE sl IS NOT NULL) OVER {box} AS lows FROM {name}_4),
{name} AS (SELECT *, lows[-1].p AS l3, lows[-2].p AS l2, lows[-3].p AS l1, highs[-1].p AS h3, highs[-2].p AS h2,
 list_filter(highs, lambda h: h.n > lows[-2].n AND h.n < lows[-1].n)[1].p AS peak, list_filter(lows, lambda l: l.n > highs[-2].n AND l.n < highs[-1].n)[1].p AS trough FROM {name}_5)"""
