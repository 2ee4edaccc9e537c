"""Research statistics over trades and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.indicators import by_ticker
from barweave.functions.ordered import ntile, with_average_rank, with_number

from .crossing import block_nodes, range_extremes


def trade_features(trades: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """Trades with the features of their signal's bar; unmatched trades are left out."""
    at = features.select("ticker", F.col("ts").alias("signal_ts"), *columns)
    return trades.join(at, ["ticker", "signal_ts"])


def excursions(trades: DataFrame, bars: DataFrame, key: tuple[str, ...] = ("ticker", "strategy", "signal_ts")) -> DataFrame:
    """Adds how far price ran for and against each trade while it was held, in per cent of the entry. The extremes come
    from blocks of bars (``crossing``), so a trade costs the logarithm of the bars it was held for. ``key`` names trades."""
    numbered = bars.withColumn("rn", F.row_number().over(by_ticker())).select("ticker", "rn", "high", "low")
    held = range_extremes(trades, block_nodes(numbered), key, "entry_rn", "exit_rn")
    out = trades.join(held.select(*key, F.col("high").alias("_h"), F.col("low").alias("_l")), [*key])
    run_up, run_down = (F.col("_h") / F.col("paid") - 1) * 100, (F.col("_l") / F.col("paid") - 1) * 100
    return out.withColumns({"mfe_pct": run_up, "mae_pct": run_down, "mfe_r": F.expr("(_h - paid) / nullif(paid - stop, 0)")}).drop("_h", "_l")


def excursion_label(mfe_r: Column, never: float = 0.3, reached: float = 0.7) -> Column:
    """Whether a trade ever worked: by how far price ran for it, in multiples of the risk."""
    return F.when(mfe_r < never, "never_worked").when(mfe_r >= reached, "reversed").otherwise("middle")


def unpivot(rows: DataFrame, keep: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """(keep..., feature, value) without nulls and non-finite values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*").where("value is not null and not isnan(value) and abs(value) < double('inf')")


def compare_groups(rows: DataFrame, flag: str, features: tuple[str, ...], by: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """Per feature: sizes, means, medians and deviations of both groups, Cohen's d, and what that is worth."""
    long = unpivot(rows, (*by, flag), features)
    v, yes = F.col("value"), F.col(flag)
    side = lambda c: F.when(c, v)
    n1, n0 = F.count(side(yes)), F.count(side(~yes))
    pooled = F.sqrt(((n1 - 1) * F.var_samp(side(yes)) + (n0 - 1) * F.var_samp(side(~yes))) / F.nullif(n1 + n0 - 2, F.lit(0)))
    d = F.when((n1 >= 2) & (n0 >= 2), (F.avg(side(yes)) - F.avg(side(~yes))) / F.nullif(pooled, F.lit(0.0)))
    out = long.groupBy(*by, "feature").agg(
        n1.alias("n_yes"), n0.alias("n_no"), F.avg(side(yes)).alias("mean_yes"), F.avg(side(~yes)).alias("mean_no"), F.percentile(side(yes), 0.5).alias("median_yes"), F.percentile(side(~yes), 0.5).alias("median_no"),
        F.stddev_pop(side(yes)).alias("std_yes"), F.stddev_pop(side(~yes)).alias("std_no"), d.alias("cohens_d"),
    )
    size = F.abs("cohens_d")
    label = F.when((F.col("n_yes") < least) | (F.col("n_no") < least) | size.isNull(), "insufficient").when(size < 0.2, "noise").when(size < 0.5, "weak").otherwise("interesting")
    return out.withColumn("effect", label)


def rank_statistics(rows: DataFrame, outcome: str, flag: str, features: tuple[str, ...]) -> DataFrame:
    """Per feature: Spearman's correlation with the outcome (null under three rows or without variance) and the
    area under the ROC curve for the flag (null with one class)."""
    long = unpivot(rows, (outcome, flag), features).where(F.col(outcome).isNotNull())
    ranked = with_average_rank(with_average_rank(long, ("feature",), "value", "rx"), ("feature",), outcome, "ry")
    n1 = F.count(F.when(F.col(flag), 1)).cast("double")
    n0 = F.count(F.when(~F.col(flag), 1)).cast("double")
    auc = (F.sum(F.when(F.col(flag), F.col("rx"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    n, sx, sy, sxy = F.count("*").cast("double"), F.sum("rx"), F.sum("ry"), F.sum(F.col("rx") * F.col("ry"))
    sxx, syy = F.sum(F.col("rx") * F.col("rx")), F.sum(F.col("ry") * F.col("ry"))
    rho = (n * sxy - sx * sy) / F.nullif(F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), F.lit(0.0))
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), F.when(n >= 3, rho).alias("spearman"), auc.alias("auc"))


def by_distance_from_half(stats: DataFrame) -> DataFrame:
    """A row per feature with its place by the distance of the area under the curve from a half; unknown ones last."""
    far = F.round(F.abs(F.coalesce("auc", F.lit(0.5)) - 0.5), 6)
    return stats.withColumn("place", F.row_number().over(Window.orderBy(far.desc(), "feature")))  # one row per feature


def ceil_deciles(rows: DataFrame, by: tuple[str, ...], value: str, order: tuple[str, ...], k: int = 10) -> DataFrame:
    """Adds ``decile``: buckets of ceil(n / k) rows, the last ones short or absent."""
    out = with_number(rows, by, (value, *order), "_number", "_total")
    size = F.ceil(F.col("_total") / k)
    return out.withColumn("decile", (F.floor((F.col("_number") - 1) / size) + 1).cast("long")).drop("_number", "_total")


def score_deciles(trades: DataFrame, by: str, score: str, order: tuple[str, ...], net: str = "net") -> DataFrame:
    """Ten buckets of near-equal size, the first ones larger by one; empty ones are listed too."""
    rows = with_number(trades, (by,), (score, *order), "_number", "_total").withColumn("decile", ntile(F.col("_number"), F.col("_total"), 10))
    found = rows.groupBy(by, "decile").agg(F.count("*").alias("n"), F.avg((F.col(net) > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean"))
    every = trades.select(by).distinct().select(by, F.explode(F.sequence(F.lit(1), F.lit(10))).alias("decile"))
    return every.join(found, [by, "decile"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def monotonicity(deciles: DataFrame, by: str, value: str) -> DataFrame:
    """How often the value falls from one decile to the next, and where."""
    w = Window.partitionBy(by).orderBy("decile")
    rows = deciles.where(F.col(value).isNotNull()).withColumn("before", F.lag(value).over(w))
    falls = F.col(value) < F.col("before")
    return rows.groupBy(by).agg(F.count(F.when(falls, 1)).alias("decreases"), F.array_join(F.sort_array(F.collect_list(F.when(falls, F.col("decile")))).cast("array<string>"), ",").alias("at"))


def thresholds(trades: DataFrame, by: str, score: str, levels: tuple[float, ...], net: str = "net") -> DataFrame:
    """Metrics of the trades at or above each level; each trade counts for all levels that it reaches."""
    reached = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda t: t <= F.col(score))
    rows = trades.select(by, net, F.explode(reached).alias("threshold"))
    return rows.groupBy(by, "threshold").agg(F.count("*").alias("n"), F.avg((F.col(net) > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean"))


def temporal_split(trades: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """Adds ``half``: 1 for the earlier half by order, else 2."""
    rows = with_number(trades, (by,), order, "_number", "_total")
    return rows.withColumn("half", F.when(F.col("_number") <= F.floor(F.col("_total") / 2), 1).otherwise(2)).drop("_number", "_total")


def win_rate_by_category(trades: DataFrame, category: Column, net: str = "net", least: int = 10) -> DataFrame:
    """Win rates by category; small ones are marked, not left out."""
    rows = trades.withColumn("category", category).where("category is not null").groupBy("category")
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(net) > 0).cast("double")).alias("win_rate")).withColumn("sufficient", F.col("n") >= least)


def integrity(trades: DataFrame, signals: DataFrame) -> DataFrame:
    """One row of counts: trades, missing scores and outcomes, repeated keys, signals that were never entered."""
    key = ("ticker", "strategy", "signal_ts")
    by = trades.groupBy(*key).agg(F.count("*").alias("n"), F.count("score").alias("s"), F.count("net").alias("o"))
    own = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trades"), F.coalesce(F.sum(F.col("n") - F.col("s")), F.lit(0)).alias("without_score"), F.coalesce(F.sum(F.col("n") - F.col("o")), F.lit(0)).alias("without_outcome"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    entered = trades.select("ticker", "strategy", F.col("signal_ts").alias("ts")).distinct()
    rest = signals.join(entered, ["ticker", "strategy", "ts"], "left_anti").agg(F.count("*").alias("not_entered"))
    return own.join(F.broadcast(rest))  # one row each
