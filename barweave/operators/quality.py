"""Validation of bars, quality scores, universe membership and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.scalars import clamp

MIN_HISTORY = 252
SEVERITY = {"INVALID_HIGH_LOW": "error", "NEGATIVE_PRICE": "error", "NEGATIVE_VOLUME": "error", "INSUFFICIENT_HISTORY": "error", "NOT_CHRONOLOGICAL": "error", "DUPLICATE_DATES": "high"}


def _with_previous(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts")
    return bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_ts", F.lag("ts").over(w))


def bar_issues(bars: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """(ticker, ts, code, severity): a row per issue; ts is null for those of a whole series."""
    missing = F.when(F.datediff("ts", "prev_ts") > 3, F.filter(F.sequence(F.date_add("prev_ts", 1), F.date_sub("ts", 1)), lambda d: F.dayofweek(d).between(2, 6)))
    rules = {
        "INVALID_HIGH_LOW": F.expr("high < low"),
        "NEGATIVE_PRICE": F.expr("open < 0 or high < 0 or low < 0 or close < 0"),
        "NEGATIVE_VOLUME": F.expr("volume < 0"),
        "HIGH_LOW_INCONSISTENT": F.expr("high < greatest(open, close)"),
        "LOW_HIGH_INCONSISTENT": F.expr("low > least(open, close)"),
        "ZERO_VOLUME": F.expr("volume = 0"),
        "LARGE_GAP": F.expr("prev_close > 0 and try_divide(abs(open - prev_close), prev_close) > 0.10"),
        "DUPLICATE_DATES": F.expr("ts = prev_ts"),
        "DATE_GAPS": F.size(missing) > 0,
    }
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))
    rows = _with_previous(bars).select("ticker", "ts", F.explode(codes).alias("code"))
    short = bars.groupBy("ticker").count().where(F.col("count") < min_history).select("ticker", F.lit(None).cast(bars.schema["ts"].dataType).alias("ts"), F.lit("INSUFFICIENT_HISTORY").alias("code"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return rows.unionByName(short).withColumn("severity", F.coalesce(severity[F.col("code")], F.lit("warning")))


def split_sane(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that can be, and those for the quarantine."""
    sane = F.expr("coalesce(high >= low and open >= 0 and close >= 0 and volume >= 0, false)")
    return bars.where(sane), bars.where(~sane)


def quality_score(bars: DataFrame) -> DataFrame:
    gap = F.expr("coalesce(try_divide(abs(open - prev_close), prev_close) > 0.10, false)")
    out = _with_previous(bars).groupBy("ticker").agg(F.count("*").alias("bars"), F.sum(F.expr("volume = 0").cast("long")).alias("zero_volume"), F.sum(gap.cast("long")).alias("large_gaps"))
    score = F.lit(1.0)
    for weight, rule in ((0.3, F.col("bars") < 60), (0.2, F.col("bars") < 252), (0.1, F.col("zero_volume") > 0.05 * F.col("bars")), (0.1, F.col("large_gaps") > 0.02 * F.col("bars"))):
        score = score - weight * rule.cast("int")
    return out.withColumn("score", clamp(score, 0.0, 1.0))


def universe_membership(bars: DataFrame, min_history: int = MIN_HISTORY, min_price: float = 5.0, min_volume: float = 500_000.0, min_dollars: float = 5_000_000.0) -> DataFrame:
    """Whether each ticker belongs, and why not; a floor is skipped where its figure is null or 0."""
    w = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    rows = bars.withColumn("back", F.row_number().over(w)).groupBy("ticker").agg(F.count("*").alias("bars"), F.max_by("close", "ts").alias("price"), F.avg(F.when(F.col("back") <= 30, F.col("volume"))).alias("avg_volume"))
    price, volume = F.expr("nullif(price, 0)"), F.expr("nullif(avg_volume, 0)")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("bars") < min_history, "Insufficient history"),
            F.when(price < min_price, "Price below minimum"),
            F.when(volume < min_volume, "Average volume below minimum"),
            F.when(price * volume < min_dollars, "Dollar volume below minimum"),
        )
    )
    return rows.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("member", F.size(reasons) == 0)


def audit_universe(bars: DataFrame, min_history: int = MIN_HISTORY, min_score: float = 0.5) -> DataFrame:
    """Per ticker: whether it passes, warning counts, error codes."""
    issues = bar_issues(bars, min_history)
    count = lambda code: F.count(F.when(F.col("code") == code, 1))
    by = issues.groupBy("ticker").agg(count("LARGE_GAP").alias("large_gaps"), count("DATE_GAPS").alias("date_gaps"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("severity") == "error", F.col("code")))), ",").alias("errors"))
    rows = quality_score(bars).select("ticker", "score").join(by, "ticker", "left")
    errors = F.coalesce("errors", F.lit(""))
    return rows.select("ticker", ((errors == "") & (F.col("score") >= min_score)).alias("passed"), F.coalesce("large_gaps", F.lit(0)).alias("large_gaps"), F.coalesce("date_gaps", F.lit(0)).alias("date_gaps"), errors.alias("errors"))


def exclude_tickers(bars: DataFrame, excluded: DataFrame) -> DataFrame:
    """Bars of tickers not listed in ``excluded`` (ticker), whatever the case."""
    return bars.join(excluded.select(F.upper("ticker").alias("_x")).distinct(), F.upper(bars["ticker"]) == F.col("_x"), "left_anti")


def parse_tickers(rows: DataFrame, column: str, most: int = 50) -> DataFrame:
    """Adds ``tickers``: trimmed, upper-cased, distinct; null if one is malformed or there are too many."""
    names = F.array_distinct(F.filter(F.transform(F.split(column, ","), lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    good = F.forall(names, lambda t: t.rlike("^[A-Z][A-Z0-9.]{0,5}$")) & (F.size(names) <= most)
    return rows.withColumn("tickers", F.when(good, names))


def top_by_liquidity(bars: DataFrame, n: int = 500) -> DataFrame:
    """The n tickers with the highest mean volume over 30 bars."""
    w = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    rows = bars.withColumn("back", F.row_number().over(w)).where("back <= 30").groupBy("ticker").agg(F.avg("volume").alias("avg_volume"))
    return rows.where("avg_volume > 0").orderBy(F.desc("avg_volume"), "ticker").limit(n)
