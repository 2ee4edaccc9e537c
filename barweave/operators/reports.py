"""What a user asks for: the scan of a day, one row on a ticker, movers, sectors, locked dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.indicators import by_ticker
from barweave.functions.scalars import div

from .signals import ranked


def scan(scored: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """The signals of the last day that has any, ranked over all tickers; then those of ``tickers``, if given."""
    last = scored.agg(F.max("ts").alias("_last"))  # one row
    today = ranked(scored.join(F.broadcast(last), F.col("ts") == F.col("_last")).drop("_last"))
    return today.where(F.upper("ticker").isin([t.upper() for t in tickers])) if tickers else today


LEVELS = ("support20", "resistance20", "support60", "resistance60")
SHOWN = ("trend", "alignment", "regime", "rsi14", "macd", "macd_signal", "macd_hist", "adx14", "atr14", "sma50", "sma200", "rel_volume", "hist_vol20", "last_sh", "last_sl", "vs_benchmark", "vs_sector")


def analyses(features: DataFrame, scored: DataFrame) -> DataFrame:
    """A row per ticker at its last bar: close, levels over 20 and 60 bars, structure, context, indicators, how many
    strategies have a setup there, and the one with the highest score (null without any)."""
    w = Window.partitionBy("ticker").orderBy("ts").rowsBetween(-60, -1)
    rows = features.withColumns({"support60": F.min("low").over(w), "resistance60": F.max("high").over(w)})
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("ts", "close", *LEVELS, *SHOWN), "ts").alias("x")).select("ticker", "x.*")
    best = scored.groupBy("ticker", "ts").agg(F.count("*").alias("setups"), F.max_by(F.struct("strategy", "score", "class", "entry", "stop", "target"), F.struct(F.round("score", 6), "strategy")).alias("best"))
    return last.join(best, ["ticker", "ts"], "left").withColumn("setups", F.coalesce("setups", F.lit(0))).select("ticker", "ts", "close", *LEVELS, *SHOWN, "setups", "best.*")


def with_detail(ranks: DataFrame, details: DataFrame, key: tuple[str, ...] = ("ticker", "ts", "strategy")) -> DataFrame:
    """Ranked rows with what is known of each, by key."""
    return ranks.join(details, list(key))


def movers(bars: DataFrame) -> DataFrame:
    """Bars with the change against the day before in per cent and the place by it that day; without one at the end."""
    before = F.lag("close").over(by_ticker())
    rows = bars.withColumn("change_pct", div(F.col("close") - before, before) * 100)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy(F.round("change_pct", 6).desc_nulls_last(), "ticker")))


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Rows with the sector of their ticker from a dimension (ticker, sector); a ticker without one, or with a null one,
    is left out."""
    return rows.join(sectors.where("sector is not null").dropDuplicates(["ticker"]), "ticker")


def locked_day(bars: DataFrame, day: Column) -> DataFrame:
    """(day, i, found): the place of a day in the calendar of ``bars``; an error if it is not there, never a day nearby."""
    days = bars.select("ts").distinct()
    at = days.agg(F.count(F.when(F.col("ts") < day, 1)).alias("i"), F.max((F.col("ts") == day).cast("int")).alias("found"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    text = F.concat(F.lit("no bars on "), day.cast("string"), F.lit(", only from "), F.coalesce(F.col("first").cast("string"), F.lit("-")), F.lit(" to "), F.coalesce(F.col("last").cast("string"), F.lit("-")))
    return at.select(day.alias("day"), F.when(F.col("found") == 1, F.col("i")).otherwise(F.raise_error(text).cast("long")).alias("i"))


def in_currency(rows: DataFrame, column: str, currency: str = "USD") -> DataFrame:
    """Rows in the currency; those that name none count as such."""
    return rows.where(F.col(column).isNull() | (F.upper(F.trim(column)) == currency))


CHART = {"volume": ("volume",), "sma20": ("sma20",), "ema50": ("ema50",), "bands": ("bb_upper", "bb_lower"), "rsi": ("rsi14",), "macd": ("macd", "macd_signal", "macd_hist")}


def chart_bundle(features: DataFrame, *chosen: str) -> DataFrame:
    """What a chart with the chosen indicators shows (all, if none is named); nulls are gaps."""
    unknown = set(chosen) - set(CHART)
    if unknown:
        raise ValueError(f"no such indicator: {', '.join(sorted(unknown))}")
    return features.select("ticker", "ts", "open", "high", "low", "close", *[c for name in chosen or CHART for c in CHART[name]])


def recent_bars(bars: DataFrame, n: int = 500) -> DataFrame:
    """The last n bars of each ticker that have all prices."""
    w = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    return bars.dropna(subset=["open", "high", "low", "close"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def search_symbols(instruments: DataFrame, text: Column, kinds: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """Instruments (symbol, name, kind) whose symbol begins with the text or whose name holds it, whatever the case and
    the space around it; symbols that begin so come first; at most ``most``."""
    key = F.upper(F.trim(text))
    rows = instruments.where(F.col("kind").isin(*kinds)) if kinds else instruments
    begins = F.startswith(F.upper("symbol"), key)
    found = rows.where(begins | F.contains(F.upper("name"), key)).withColumn("_b", begins)
    return found.orderBy(F.desc("_b"), "symbol").limit(most).drop("_b")


def with_history(found: DataFrame, trades: DataFrame, least: int = 20) -> DataFrame:
    """Signals with how their strategy's trades went in the same regime and on the same ticker; ``sufficient`` where the
    strategy has ``least`` trades. What has no history stays, with nulls. All trades count, those that were closed after a
    signal, too: see ``with_history_as_of`` for what was known then."""

    def stats(*keys: str, name: str) -> DataFrame:
        return trades.groupBy(*keys).agg(F.count("*").alias(f"{name}_trades"), F.avg((F.col("net") > 0).cast("double")).alias(f"{name}_win_rate"))

    out = found.join(stats("strategy", "regime", name="regime"), ["strategy", "regime"], "left").join(stats("strategy", "ticker", name="ticker"), ["strategy", "ticker"], "left")
    whole = trades.groupBy("strategy").agg((F.count("*") >= least).alias("sufficient"))
    return out.join(whole, "strategy", "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))


def with_history_as_of(found: DataFrame, trades: DataFrame, least: int = 20) -> DataFrame:
    """Signals with how the trades of their strategy had gone by then, in the same regime and on the same ticker: only
    those closed before the signal's day count. ``sufficient`` where the strategy had ``least`` of them.

    Closed trades are added up by day first; running sums over days then serve all signals of a day."""
    out = found
    won = (F.col("net") > 0).cast("long")
    for keys, name in ((("strategy", "regime"), "regime"), (("strategy", "ticker"), "ticker"), (("strategy",), "strategy")):
        closed = trades.select(*keys, F.col("exit_ts").alias("ts"), F.lit(1).alias("_n"), won.alias("_won"))
        asked = found.select(*keys, "ts").distinct().select(*keys, "ts", F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_won"))
        days = closed.unionByName(asked).groupBy(*keys, "ts").agg(F.sum("_n").alias("_n"), F.sum("_won").alias("_won"))
        before = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        n, wins = F.coalesce(F.sum("_n").over(before), F.lit(0)), F.sum("_won").over(before)
        known = days.select(*keys, "ts", n.alias(f"{name}_trades"), F.try_divide(wins.cast("double"), F.nullif(n, F.lit(0))).alias(f"{name}_win_rate"))
        out = out.join(known, [*keys, "ts"], "left")
    return out.withColumn("sufficient", F.col("strategy_trades") >= least).drop("strategy_win_rate")


def recent_news(items: DataFrame, now: Column, days: int = 7, most: int = 30) -> DataFrame:
    """Of each symbol the ``most`` newest items (symbol, id, ts, ...) of the last ``days`` days before ``now``, both ends
    included by their dates; newest first, ties by the greater id."""
    day = F.to_date("ts")
    recent = items.where(day.between(F.date_sub(F.to_date(now), days), F.to_date(now)))
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("id"))
    return recent.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")
