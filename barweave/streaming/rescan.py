"""Signals that are kept up to date while bars arrive: each micro-batch of bars is merged, scanned, and its signals merged.

One batch runs at a time, and batches that come while a scan runs wait together for the next one. Both tables are merged
exactly once per batch (``MergedTable``), so a scan that was lost with its driver is done again, and changes nothing where
it had come through."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions import resume
from barweave.schema import BARS
from barweave.sources.store import MergedTable

YEAR = "date_format(ts, 'yyyy')"


class LiveScan:
    """``scan`` gives signals (ticker, ts, ...) from all bars, and must be causal: bars of later days do not change it.

    Signals are stored per day, ticker and bar, also where there are none, so that a bar that is corrected takes back the
    signals it no longer gives. From the first year that a batch touches on all tickers are stored anew, since a bar of an
    index or sector changes the signals of others.

    A scan that ``resumes`` is given no history: each ticker's bars start at a stored state (``functions.resume``), some
    five years back, however long the series is; ``_carried`` holds that state, and ``features_daily``, ``add_structure``
    and ``daily_context`` go on from it."""

    def __init__(self, spark: SparkSession, path: str, scan: Callable[[DataFrame], DataFrame], signal: str, resumes: bool = False):
        """``signal``: the columns of a signal beside ticker and ts, as DDL."""
        self.scan = scan
        self.signal = spark.createDataFrame([], signal).schema
        stored = T.StructType([*BARS.fields[:2], T.StructField("found", T.ArrayType(self.signal))])
        self.bars = MergedTable(spark, f"{path}/bars", BARS, ("ticker", "ts"), YEAR)
        self.days = MergedTable(spark, f"{path}/signals", stored, ("ticker", "ts"), YEAR)
        self.states = MergedTable(spark, f"{path}/states", resume.STATES, ("ticker", "year"), "cast(year as string)") if resumes else None

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.bars.merge(batch, batch_id)
        # The batch as it was merged: a stream's own batch is computed once.
        first = self.bars.version(batch_id).agg(F.min("ts")).first()[0]
        if first is None:
            return
        bars = self._bars(first)
        held = F.struct(*self.signal.fieldNames())
        found = self.scan(bars).where(F.col("ts") >= F.lit(first)).groupBy("ticker", "ts").agg(F.sort_array(F.collect_list(held)).alias("found"))
        rows = bars.where(F.col("ts") >= F.lit(first)).select("ticker", "ts").join(found, ["ticker", "ts"], "left")
        none = F.array().cast(T.ArrayType(self.signal))
        self.days.merge(rows.withColumn("found", F.coalesce("found", none)), batch_id)
        if self.states is not None:
            self.states.merge(resume.year_states(bars, first.year), batch_id)

    def _bars(self, first: dt.date) -> DataFrame:
        """What the scan reads for the rows from ``first`` on. A batch that is done again finds states that have seen it,
        which do not count, so it starts from earlier ones."""
        if self.states is None:
            return self.bars.read()
        points = resume.starting_points(self.states.read(), first)
        since = points.agg(F.min("since")).first()[0] or first
        return resume.tails(self.bars.read(str(min(since, first).year)), points, first)

    def signals(self) -> DataFrame:
        """(ticker, ts, the signal's columns) as of the last batch."""
        return self.days.read().select("ticker", "ts", F.inline("found"))

    def start(self, bars: DataFrame, checkpoint: str, every: str = "30 minutes"):
        """Runs with a stream of bars."""
        return bars.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
