"""The wide feature row, signals, ranking, and what became of each signal on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.functions import context as X
from barweave.functions import indicators as I
from barweave.functions import structure as S
from barweave.functions.scalars import check_exit, with_slippage
from barweave.sources import bars as B

from . import strategies as G
from .crossing import block_nodes, first_crossing


def daily_context(bars: DataFrame, indices: DataFrame, benchmark: str, sectors: DataFrame, sector) -> DataFrame:
    """Features, structure, pattern frames, trends of both time frames, regime and relative strength per bar.
    Everything is causal, so a row is what a series that ends there gives. Bars may go on from a state (``resume``)."""
    out = S.add_pattern_frames(S.add_structure(I.features_daily(bars)))
    out = X.add_timeframes(out, bars)
    base = indices.where(F.col("ticker") == benchmark)
    out = X.relative_strength(out, base, sectors, sector)
    out = out.join(X.market_regime(indices).select("ts", "regime"), "ts", "left")
    return out.join(base.select("ts", I.roc(12).alias("benchmark_roc12")), "ts", "left").drop("_carried")


def walk_context(spark: SparkSession, sf: str, universe: str = "by_type") -> DataFrame:
    """The feature rows of a universe, computed once in an application."""

    def build() -> DataFrame:
        return daily_context(B.walk(spark, sf, universe), B.indices(spark, sf), "ALL", B.walk(spark, sf, "by_region"), B.sector_of(F.col("ticker")))

    return B.once(spark, f"context {sf} {universe}", build)


def intraday_context(bars: DataFrame) -> DataFrame:
    out = I.features_intraday(bars)
    touch = F.when((F.col("low") <= F.col("vwap")) & (F.try_divide(F.col("vwap") - F.col("low"), F.col("vwap")) <= 0.003), F.col("low"))
    return out.withColumn("_touch", touch).withColumn("touched_low", F.min("_touch").over(I.frame(-5, -1))).drop("_touch")


def scored_signals(features: DataFrame, strategies: dict | None = None) -> DataFrame:
    return G.add_score(G.signals(features, strategies or G.DAILY, keep=("rn", *G.SCORE_INPUTS)))


def ranked(scored: DataFrame) -> DataFrame:
    """Rank 1 .. n among the signals of a date, by score; ties by ticker and strategy."""
    w = Window.partitionBy("ts").orderBy(F.desc("score"), "ticker", "strategy")
    return scored.withColumn("rank", F.row_number().over(w))


def best_per_ticker(scored: DataFrame) -> DataFrame:
    """Each ticker's signal with the highest score, ties by the number of reasons, then the latest."""
    w = Window.partitionBy("ticker").orderBy(F.desc("score"), F.desc(F.size("evidence")), F.desc("ts"), "strategy")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trade_outcomes(found: DataFrame, bars: DataFrame, slippage_bps: float = 5.0) -> DataFrame:
    """Each signal traded on its own: in at the next open, out at the first bar (from the entry's on) that reaches the
    stop or the target, moved with the entry, however long that takes; else at the close of the ticker's last bar.

    The exit is searched in blocks of bars (``crossing``), so a trade costs the logarithm of the bars it could be held
    for. All joins are equalities on bar numbers."""
    numbered = bars.withColumn("rn", F.row_number().over(I.by_ticker())).select("ticker", "rn", "ts", "open", "high", "low", "close")
    first = numbered.select("ticker", F.col("rn").alias("entry_rn"), F.col("ts").alias("entry_ts"), F.col("open").alias("entry_open"))
    entered = found.withColumn("entry_rn", F.col("rn") + 1).join(first, ["ticker", "entry_rn"])
    shift = F.col("entry_open") - F.col("entry")
    entered = entered.withColumns(
        {
            "signal_ts": F.col("ts"),
            "stop": F.col("stop") + shift,
            "target": F.col("target") + shift,
            "paid": with_slippage(F.col("entry_open"), slippage_bps, True),
        }
    )
    trades = entered.select("ticker", "strategy", "signal_ts", "entry_ts", "entry_rn", "paid", "stop", "target", "score", "regime")
    key = ("ticker", "strategy", "signal_ts")
    hits = first_crossing(trades, block_nodes(numbered), key, "entry_rn", "stop", "target")
    last = numbered.groupBy("ticker").agg(F.max("rn").alias("_last"))
    ended = trades.join(hits, [*key], "left").join(last, "ticker").withColumn("exit_rn", F.coalesce("hit_rn", "_last")).drop("hit_rn", "_last")

    at = numbered.select("ticker", F.col("rn").alias("exit_rn"), F.col("ts").alias("exit_ts"), "open", "high", "low", "close")
    met = ended.join(at, ["ticker", "exit_rn"]).withColumn("_out", check_exit(F.col("open"), F.col("high"), F.col("low"), F.col("stop"), F.col("target")))
    out = met.withColumns(
        {
            "exit_reason": F.coalesce("_out.reason", F.lit("end_of_data")),
            "got": with_slippage(F.coalesce("_out.price", "close"), slippage_bps, False),
        }
    )
    out = out.select(*trades.columns, "exit_ts", "exit_rn", "exit_reason", "got")
    return out.withColumns(
        {
            "net": F.col("got") - F.col("paid"),
            "r_multiple": F.expr("(got - paid) / nullif(paid - stop, 0)"),
            "return_pct": F.expr("(got - paid) / nullif(paid, 0) * 100"),
            "bars_held": F.col("exit_rn") - F.col("entry_rn") + 1,
        }
    )
