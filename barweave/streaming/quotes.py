"""Quotes, their changes and live bars: batch forms, and the same as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.schema import TICKS


# --- batch ------------------------------------------------------------------------------------------------


def latest_quote(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"), F.count("*").alias("ticks"))


def with_stale(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Every known symbol with its fresh quote, or the known one marked stale."""
    now = fresh.select("symbol", F.col("price").alias("_p"), F.col("ts").alias("_t"))
    rows = known.join(now, "symbol", "left")
    return rows.select("symbol", F.coalesce("_p", "price").alias("price"), F.coalesce("_t", "ts").alias("ts"), F.col("_t").isNull().alias("stale"))


def changes(ticks: DataFrame, bucket: str = "day") -> DataFrame:
    """Ticks whose price is not that of the tick before of the same symbol.

    Ticks are compared inside buckets of time, so that one symbol's ticks spread over many tasks; a bucket's first tick
    is compared with the last one of the bucket before, which a window over one row per bucket hands on."""
    rows = ticks.withColumn("_k", F.date_trunc(bucket, "ts"))
    ends = rows.groupBy("symbol", "_k").agg(F.max_by("price", F.struct("ts", "event_id")).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_k"))).drop("_last")
    within = F.lag("price").over(Window.partitionBy("symbol", "_k").orderBy("ts", "event_id"))
    before = F.coalesce(F.col("_within"), F.col("_carried"))
    out = rows.withColumn("_within", within).join(carried, ["symbol", "_k"]).where(before.isNull() | (F.col("price") != before))
    return out.select(*ticks.columns)


# --- streams ----------------------------------------------------------------------------------------------


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_bars(ticks: DataFrame, step: str = "1 hour", late: str = "0 seconds", zone: str | None = None) -> DataFrame:
    """Bars over tumbling windows; ticks behind the watermark are dropped. A step of weeks begins on Mondays. With a
    ``zone``, days and weeks are those of its clock, and ``ts`` is local time."""
    seq = F.struct("ts", "event_id")
    start = "4 days" if "week" in step else "0 seconds"  # the epoch is a Thursday
    rows = ticks.withColumn("_at", F.from_utc_timestamp("ts", zone) if zone else F.col("ts")).withWatermark("_at", late)
    out = rows.groupBy("symbol", F.window("_at", step, step, start).alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out.select(F.col("symbol").alias("ticker"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_changes(ticks: DataFrame) -> DataFrame:
    """Emits a symbol's quote when its time and price are newer than what was emitted last; one small state per
    symbol."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        times = rows["ts"].astype("int64")
        seen, price = state.get if state.exists else (None, None)
        on_time = rows if seen is None else rows[times >= seen]
        before = on_time["price"].shift(fill_value=float("nan") if price is None else price)
        if len(on_time):
            price = float(on_time["price"].iloc[-1])
        newest = int(times.max())
        state.update((newest if seen is None else max(seen, newest), price))
        yield on_time.loc[on_time["price"] != before, ["symbol", "ts", "price"]]

    out, held = "symbol string, ts timestamp, price double", "seen long, price double"
    return ticks.groupBy("symbol").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def new_signals(signals: DataFrame, remember: str = "1 day") -> DataFrame:
    """Signals other than AVOID, each ticker, strategy and day once."""
    day = F.concat_ws(":", "ticker", "strategy", F.date_format("ts", "yyyy-MM-dd"))
    return signals.where("class <> 'AVOID'").withColumn("key", day).withWatermark("ts", remember).dropDuplicatesWithinWatermark(["key"])


def to_batches(stream: DataFrame, handle, checkpoint: str, trigger: str = "30 seconds"):
    """Runs ``handle(batch, id)`` for each micro-batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
