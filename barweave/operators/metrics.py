"""Performance metrics: grouped aggregates over trades and equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.ordered import with_number
from barweave.functions.scalars import clamp


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def trade_aggregates(net: str = "net") -> list[Column]:
    """Columns for one ``agg``: counts, averages, profit factor (infinite without losses, 0 without trades)."""
    x = F.col(net)
    won, lost = F.sum(F.when(x > 0, x)), F.sum(F.when(x < 0, -x))
    wins, losses, n = F.count(F.when(x > 0, 1)), F.count(F.when(x < 0, 1)), F.count(x)
    factor = F.when(_or0(lost) > 0, _or0(won) / lost).when(_or0(won) > 0, F.lit(float("inf"))).otherwise(0.0)
    return [
        n.alias("trades"), wins.alias("wins"), losses.alias("losses"), _or0(wins / F.nullif(n, F.lit(0))).alias("win_rate"), _or0(F.avg(F.when(x > 0, x))).alias("avg_win"), _or0(F.avg(F.when(x < 0, x))).alias("avg_loss"),
        factor.alias("profit_factor"), _or0(F.avg(x)).alias("expectancy"), _or0(F.max(x)).alias("best"), _or0(F.min(x)).alias("worst"),
    ]


def trade_metrics(trades: DataFrame, *by: str, net: str = "net") -> DataFrame:
    return trades.where(F.col(net).isNotNull()).groupBy(*by).agg(*trade_aggregates(net))


def bucket_metrics(trades: DataFrame, keys: dict[str, Column], net: str = "net") -> DataFrame:
    """(dimension, bucket, ...): metrics by each key on its own, in one pass; null keys are left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), key.cast("string").alias("bucket")) for name, key in keys.items()])
    rows = trades.where(F.col(net).isNotNull()).select(net, F.explode(pairs).alias("k")).select(net, "k.*").where("bucket is not null")
    return rows.groupBy("dimension", "bucket").agg(*trade_aggregates(net))


def equity_from_trades(trades: DataFrame, by: str, capital: float, net: str = "net") -> DataFrame:
    """Equity at each exit date, from the capital and the trades' results."""
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    days = trades.groupBy(by, F.col("exit_ts").alias("ts")).agg(F.sum(net).alias("pnl"))
    return days.withColumn("equity", capital + F.sum("pnl").over(w))


def drawdown(equity: DataFrame, by: str) -> DataFrame:
    """Adds the running peak and the fraction below it."""
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))


def equity_metrics(equity: DataFrame, by: str, capital: float, periods: int = 252) -> DataFrame:
    """Total return, CAGR, Sharpe, Sortino, largest drawdown, volatility from (by, ts, equity)."""
    w = Window.partitionBy(by).orderBy("ts")
    before = F.lag("equity").over(w)
    rows = drawdown(equity, by).withColumn("r", F.when(before > 0, F.col("equity") / before - 1))
    root = float(periods) ** 0.5
    mean, down = F.avg("r"), F.sqrt(F.avg(F.pow(F.least("r", F.when(F.col("r").isNotNull(), F.lit(0.0))), 2)))
    years = F.greatest(F.datediff(F.max("ts"), F.min("ts")) / 365.25, F.lit(1 / 365.25))
    last = F.max_by("equity", "ts")
    return rows.groupBy(by).agg(
        (last / capital - 1).alias("total_return"),
        F.when(last <= 0, -1.0).otherwise(F.pow(F.greatest(last, F.lit(0.0)) / capital, 1 / years) - 1).alias("cagr"),
        _or0(mean / F.nullif(F.stddev_pop("r"), F.lit(0.0)) * root).alias("sharpe"),
        _or0(mean / F.nullif(down, F.lit(0.0)) * root).alias("sortino"),
        F.max("drawdown").alias("max_drawdown"),
        _or0(F.sqrt(F.avg(F.pow("r", 2))) * root).alias("volatility"),
    )


def streaks(trades: DataFrame, by: str, order: tuple[str, ...], net: str = "net", size: int = 4096) -> DataFrame:
    """Longest runs of wins and of losses in order; a break-even trade ends both.

    Runs are found inside buckets of ``size`` trades. Those within a bucket are whole; its first and its last one may go on
    in the buckets beside it, so these, two rows a bucket, are put together in order."""
    rows = with_number(trades.select(by, net, *dict.fromkeys(c for c in order if c not in (by, net))), (by,), order, "_number", "_total")
    rows = rows.select(by, F.signum(net).alias("sign"), F.col("_number").alias("n"), F.floor((F.col("_number") - 1) / size).alias("bucket"))
    inside = Window.partitionBy(by, "bucket").orderBy("n")
    island = F.col("n") - F.row_number().over(Window.partitionBy(by, "bucket", "sign").orderBy("n"))
    runs = rows.withColumn("island", island).groupBy(by, "bucket", "sign", "island").agg(F.count("*").alias("size"), F.min("n").alias("n"))
    last = F.lead("n").over(inside).isNull()
    runs = runs.withColumns({"first": F.lag("n").over(inside).isNull(), "last": last})

    # A last run follows its bucket's first one only after others; a run that is both goes on with the run before it.
    ordered = Window.partitionBy(by).orderBy("n")
    ends = runs.where(F.col("first") | F.col("last"))
    begins = ~F.col("first") | F.coalesce(F.col("sign") != F.lag("sign").over(ordered), F.lit(True))
    chains = ends.withColumn("begins", begins.cast("int")).withColumn("chain", F.sum("begins").over(ordered))
    whole = chains.groupBy(by, "chain", "sign").agg(F.sum("size").alias("size")).select(by, "sign", "size")
    found = whole.unionByName(runs.where(~F.col("first") & ~F.col("last")).select(by, "sign", "size"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("size"))), F.lit(0))
    return found.groupBy(by).agg(longest(1).alias("longest_wins"), longest(-1).alias("longest_losses"))


def concentration(trades: DataFrame, by: str, net: str = "net") -> DataFrame:
    """How much of the result the best tickers make."""
    tickers = trades.groupBy(by, "ticker").agg(F.sum(net).alias("pnl"), F.avg(net).alias("mean"))
    w = Window.partitionBy(by).orderBy(F.desc("pnl"), "ticker")
    rows = tickers.withColumn("rank", F.row_number().over(w))
    total = F.sum("pnl")
    return rows.groupBy(by).agg(
        F.count("*").alias("tickers"), total.alias("total"), F.when(total == 0, 0.0).otherwise(F.sum(F.when(F.col("rank") <= 5, F.col("pnl"))) / F.nullif(total, F.lit(0.0)) * 100).alias("top5_pct"),
        F.percentile("pnl", 0.5).alias("median_pnl"), F.count(F.when(F.col("mean") > 0, 1)).alias("positive"), F.count(F.when(F.col("mean") < 0, 1)).alias("negative"),
    )


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the win rate; 0, 0 without trades."""
    p, d = wins / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / d
    return _or0(clamp(mid - half, 0.0, 1.0)), _or0(clamp(mid + half, 0.0, 1.0))


def summary(values: DataFrame, by: str, column: str) -> DataFrame:
    """Mean, population deviation and their ratio over finite values."""
    x = F.when(~F.col(column).isin(float("inf"), float("-inf")), F.col(column))
    mean, std = _or0(F.avg(x)), _or0(F.stddev_pop(x))
    return values.groupBy(by).agg(mean.alias("mean"), std.alias("std"), _or0(std / F.nullif(F.abs(mean), F.lit(0.0))).alias("cv"))


def evidence(trades: DataFrame, by: str, consistent: Column | None = None, robust: Column | None = None) -> DataFrame:
    """How much a sample can say: a point each for size, stocks, years, regimes, consistency, robustness."""
    rows = trades.groupBy(by).agg(F.count("*").alias("trades"), F.count_distinct("ticker").alias("tickers"), F.count_distinct(F.year("entry_ts")).alias("years"), F.count_distinct("regime").alias("regimes"))
    points = sum(((F.col(c) >= least).cast("int") for c, least in (("trades", 50), ("tickers", 15), ("years", 4), ("regimes", 3))), F.lit(0))
    for extra in (consistent, robust):
        points = points if extra is None else points + F.coalesce(extra.cast("int"), F.lit(0))
    level = F.when((F.col("trades") < 20) | (F.col("tickers") < 5), "INSUFFICIENT_SAMPLE").when(points <= 1, "WEAK_EVIDENCE").when(points <= 3, "PROMISING").otherwise("STRONGER_EVIDENCE")
    return rows.withColumn("evidence", level)
