"""Bars from raw rows, and readers and writers of bar tables."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.schema import BARS

from .store import newest

#: Keeps products of few digits off the ties of rounding.
TIE = 3e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str, universe: str = "by_type") -> DataFrame:
    """Line items as trades: ticker, ts, price, quantity, discount and the full tie-break tuple. They are never sorted to
    meet their part or supplier: a partition holds its few of those as a hash table."""
    line = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq")
    if universe == "by_supplier":
        rows = line.withColumn("ticker", F.col("l_suppkey").cast("string"))
    elif universe == "all":
        rows = line.withColumn("ticker", F.lit("ALL"))
    elif universe == "by_region":
        place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = line.join(place.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("ticker")).hint("shuffle_hash"), "l_suppkey")
    else:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type" if universe == "by_type" else "p_brand").alias("ticker"))
        rows = line.join(part.hint("shuffle_hash"), "l_partkey")
    return rows.select("ticker", F.to_date("l_shipdate").alias("ts"), F.expr("l_extendedprice / nullif(l_quantity, 0)").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), order)


def raw_bars(trades: DataFrame) -> DataFrame:
    """Daily bars of traded prices; open and close by the full order of the trades."""
    return trades.groupBy("ticker", "ts").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume")
    )


def cents(amount: Column) -> Column:
    """Whole hundredths, halves away from zero: what ``round`` gives, without a decimal per row."""
    whole = (amount * 100).cast("long")
    rest = amount * 100 - whole
    return whole + F.when(rest >= 0.5, 1).when(rest <= -0.5, -1).otherwise(0)


def _cents() -> list[Column]:
    return [F.sum(cents(F.col("discount"))).alias("cents"), F.count("*").alias("n")]


def _walk_close() -> Column:
    """The close of a day (cents, n) on its ticker's path."""
    micros = F.round((F.col("cents") / (F.col("n") * 100.0) - 0.05) * 1000000).cast("long")
    return F.round(F.exp(F.sum(micros).over(Window.partitionBy("ticker").orderBy("ts")) / 1000000.0) * 100, 4)


def walk_closes(trades: DataFrame) -> DataFrame:
    """(ticker, ts, close) of ``walk_bars``, for what needs no more of them."""
    return trades.groupBy("ticker", "ts").agg(*_cents()).select("ticker", "ts", _walk_close().alias("close"))


def walk_bars(trades: DataFrame) -> DataFrame:
    """Daily bars of a price path: mean discounts less 5 % are added up as returns, in whole millionths so that
    the order of rows cannot matter; the day's spread of discounts widens the range."""
    day = trades.groupBy("ticker", "ts").agg(*_cents(), (F.max("discount") - F.min("discount")).alias("spread"), F.sum("quantity").alias("volume"))
    w = Window.partitionBy("ticker").orderBy("ts")
    close = _walk_close()
    rows = day.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    high = F.round(F.greatest("open", "close") * (1 + F.col("spread") * 0.1) + TIE, 4)
    low = F.round(F.least("open", "close") * (1 - F.col("spread") * 0.1) + TIE, 4)
    return rows.select("ticker", "ts", "open", high.alias("high"), low.alias("low"), "close", "volume")


def _shared(spark: SparkSession) -> str | None:
    """The folder that all executors share; in local mode a temporary one where none is named."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and context.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="barweave-")
        context.setCheckpointDir(base)
    return base


def once(spark: SparkSession, name: str, build, time: str = "ts") -> DataFrame:
    """A table of (ticker, time, ...) that is built once in an application and read from then on: written below
    ``spark.checkpoint.dir`` as sorted Parquet, removed with the application. On a cluster without that setting,
    ``build()`` as it is."""
    base = _shared(spark)
    if not base:
        return build()
    context = spark.sparkContext
    path = f"{base.rstrip('/')}/bars-{context.applicationId}/{hashlib.sha256(name.encode()).hexdigest()[:16]}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        _sorted(build(), time).write.mode("overwrite").parquet(path)
        files.deleteOnExit(folder)
    return spark.read.parquet(path)


def _sorted(rows: DataFrame, time: str = "ts") -> DataFrame:
    """A file for some years of a ticker, sorted by both so that row groups prune."""
    return rows.repartition("ticker", F.date_trunc("year", time)).sortWithinPartitions("ticker", time)


def walk(spark: SparkSession, sf_dir: str, universe: str = "by_type") -> DataFrame:
    """The bars of a universe; raw rows are read once for all queries of an application."""
    return once(spark, f"walk {sf_dir} {universe}", lambda: walk_bars(prints(spark, sf_dir, universe)))


def indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the benchmark (ALL) and of two more indices."""
    return walk(spark, sf_dir, "all").unionByName(walk(spark, sf_dir, "by_region").where(F.col("ticker").isin("AMERICA", "ASIA")))


#: Sectors of the supplied universes, in order.
SECTORS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def sector_of(ticker: Column) -> Column:
    """A sector for a ticker that comes without one."""
    return F.element_at(F.array(*map(F.lit, SECTORS)), (F.ascii(ticker) % 5 + 1).cast("int"))


def sector_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector) of the universe by_supplier: the region of a supplier's nation, null where its country is unknown."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("sector"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(place), "s_nationkey", "left").select(F.col("s_suppkey").cast("string").alias("ticker"), "sector")  # a row per nation


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol is the event's type, price its value, never below a cent."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), F.greatest(F.col("value"), F.lit(0.01)).alias("price"), "user_id")


def intraday_bars(rows: DataFrame, step: str = "1 hour") -> DataFrame:
    """Bars of ticks over tumbling windows; volume counts ticks."""
    seq = F.struct("ts", "event_id")
    out = rows.groupBy(F.col("symbol").alias("ticker"), F.window("ts", step).alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Weeks from Monday; the current week is partial."""
    return bars.groupBy("ticker", F.date_trunc("week", "ts").cast("date").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("days")
    )


def first_per_timestamp(bars: DataFrame, order: Column) -> DataFrame:
    """One bar for each ticker and time: the first in ``order``."""
    w = Window.partitionBy("ticker", "ts").orderBy(order)
    return bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_pages(pages: list[DataFrame], start: str, end: str) -> DataFrame:
    """Pages of a paged scan put together: earlier pages win, times outside of [start, end] go."""
    rows = None
    for no, page in enumerate(pages):
        page = page.withColumn("_page", F.lit(no))
        rows = page if rows is None else rows.unionByName(page)
    return first_per_timestamp(rows.where(F.col("ts").between(start, end)), F.col("_page")).drop("_page")


def read_bars(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, max_age_hours: float | None = None) -> DataFrame:
    """A stored bar table; of bars that were written twice the later one counts. Filters on tickers and days reach the
    scan; ``max_age_hours`` drops what was written earlier."""
    rows = spark.read.parquet(path)
    if tickers:
        rows = rows.where(F.col("ticker").isin(tickers))
    if start:
        rows = rows.where(F.col("ts") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("ts") <= F.to_date(F.lit(end)))
    if "cached_at" in rows.columns:
        rows = newest(rows)
    if max_age_hours is not None and "cached_at" in rows.columns:
        rows = rows.where(F.col("cached_at") >= F.current_timestamp() - F.make_interval(hours=F.lit(int(max_age_hours))))
    return rows


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Bars as sorted Parquet, with the time at which they were written."""
    _sorted(bars.withColumn("cached_at", F.current_timestamp())).write.mode(mode).parquet(path)


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """Per-ticker JSON files of the shape {ticker, candles: [...], cachedAt}: a row per bar."""
    candle = "struct<timestamp:timestamp,open:double,high:double,low:double,close:double,volume:double>"
    files = spark.read.schema(f"ticker string, candles array<{candle}>, cachedAt timestamp").option("multiLine", True).json(path)
    return files.select("ticker", F.inline("candles")).select("ticker", F.to_date("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS).option("header", True).csv(path)
