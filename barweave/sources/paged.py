"""Bars from a paged source, as a data source of Spark.

A pager answers "the newest bars of a ticker between two times, at most so many". The source cuts what is asked for into
slices of time, a partition each, that never take more than ``max_pages`` pages; a task pages through its slice backwards,
from just before the earliest bar it has, until a page is short or the slice's start is reached."""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
#: Lengths of bars that can be asked for, in seconds; bars of a page, and pages of a request, at most.
INTERVALS = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600}
PAGE_SIZE, MAX_PAGES = 5000, 20
_SECOND = dt.timedelta(seconds=1)


class Slice(InputPartition):
    def __init__(self, ticker: str, start: dt.datetime, end: dt.datetime):
        self.ticker, self.start, self.end = ticker, start, end


def pages(pager, ticker: str, interval: str, start: dt.datetime, end: dt.datetime, size: int) -> Iterator[list[tuple]]:
    """Pages of (ts, open, high, low, close, volume) from the newest backwards."""
    while start <= end:
        page = list(pager(ticker, interval, start, end, size))
        if page:
            yield page
        if len(page) < size:
            return
        end = min(row[0] for row in page) - _SECOND


class PagedBars(DataSource):
    """Options: ``pager`` (module:function that every executor can import; called with ticker, interval, start, end and a
    limit), ``tickers`` (comma-separated), ``interval``, ``start`` and ``end`` (ISO times, both included), ``page_size``,
    ``max_pages``."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pager, self.interval = options["pager"], options["interval"]
        if self.interval not in INTERVALS:
            raise ValueError(f"no such interval: {self.interval}")
        self.tickers = sorted({t.strip() for t in options["tickers"].split(",") if t.strip()})
        self.start, self.end = (dt.datetime.fromisoformat(options[c]) for c in ("start", "end"))
        self.size, self.max_pages = int(options.get("page_size", PAGE_SIZE)), int(options.get("max_pages", MAX_PAGES))

    def partitions(self) -> list[InputPartition]:
        """Slices with as many intervals as ``max_pages`` pages hold; at least one, so that Spark has a partition."""
        span = dt.timedelta(seconds=INTERVALS[self.interval] * self.size * self.max_pages)
        slices = []
        for ticker in self.tickers:
            at = self.start
            while at <= self.end:
                slices.append(Slice(ticker, at, min(at + span - _SECOND, self.end)))
                at += span
        return slices or [Slice("", self.end + _SECOND, self.end)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        module, function = self.pager.split(":")
        pager = getattr(importlib.import_module(module), function)
        for page in pages(pager, partition.ticker, self.interval, partition.start, partition.end, self.size):
            for row in page:
                # What the source gives beyond its slice is another slice's, or nobody's.
                if partition.start <= row[0] <= partition.end:
                    yield (partition.ticker, *row)


def read_paged(spark: SparkSession, pager: str, tickers: list[str], interval: str, start: dt.datetime, end: dt.datetime, **options) -> DataFrame:
    """Bars of the tickers between two times, both included, each time once (of repeated ones the greatest)."""
    spark.dataSource.register(PagedBars)
    asked = {"pager": pager, "tickers": ",".join(tickers), "interval": interval, "start": start.isoformat(), "end": end.isoformat(), **options}
    rows = spark.read.format("paged_bars").options(**{k: str(v) for k, v in asked.items()}).load()
    prices = ("open", "high", "low", "close", "volume")
    once = rows.groupBy("ticker", "ts").agg(F.max(F.struct(*prices)).alias("_x"))
    return once.select("ticker", "ts", *[F.col("_x")[c].alias(c) for c in prices])
